"""Identifiers in plain and disguised form against direct patterns, and spans back in the source."""

import hashlib
import random
import re

import pytest

from itemloom.llm import identifiers

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
DISGUISED = {
    "write john dot doe (at) example [dot] com now": ("email", "john dot doe (at) example [dot] com", "john.doe@example.com"),
    "jоhn@exаmple.com": ("email", "jоhn@exаmple.com", "john@example.com"),
    "we met john at mail dot example dot com": ("email", "john at mail dot example dot com", "john@mail.example.com"),
    "max arroba correo punto es": ("email", "max arroba correo punto es", "max@correo.es"),
    "john_at_example_dot_com": ("email", "john_at_example_dot_com", "john@example.com"),
    "ab​c@d.de": ("email", "ab​c@d.de", "abc@d.de"),
    "é １９２．１６８．１．１": ("ip", "１９２．１６８．１．１", "192.168.1.1"),
    "at 192 dot 168 [dot] 1 dot 1!": ("ip", "192 dot 168 [dot] 1 dot 1", "192.168.1.1"),
    "one nine two dot one six eight dot one dot one": ("ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
    "four one" + " one" * 14: ("card", "four one" + " one" * 14, "4111111111111111"),
    "4041 8949 7460 8795": ("card", "4041 8949 7460 8795", "4041 8949 7460 8795"),
    "call plus one five-five-five one two three four five six seven": ("phone", "plus one five-five-five one two three four five six seven", "+15551234567"),
    "pay 4041 eight nine four nine 7460 8795 now": ("card", "4041 eight nine four nine 7460 8795", "4041 8949 7460 8795"),
    "4O41 8949 7460 8795": ("card", "4O41 8949 7460 8795", "4041 8949 7460 8795"),
    "hi j.doe @ mail.example.com": ("email", "j.doe @ mail.example.com", "j.doe@mail.example.com"),
    "J.DOE AT MAIL DOT EXAMPLE DOT COM": ("email", "J.DOE AT MAIL DOT EXAMPLE DOT COM", "J.DOE@MAIL.EXAMPLE.COM"),
    "+٤٩ ١٢٣ ٤٥٦٧": ("phone", "+٤٩ ١٢٣ ٤٥٦٧", "+49 123 4567"),
}
CLEAN = ["", "look at the dot here", "it is at home. One, two, three.", "the dot product at one point two", "wir sind at work punkt", "half past one dot two", "6 @ 3.50 each, un sept", "Élan ﬁn ½ … «là»"]


def direct(text):
    """Base spans by the patterns as they are written."""
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if k == 2:
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(x // 10 + x % 10 for x in twice) % 10:
                    continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            found.append((k, *m.span()))
    return found


def base(text):
    return [f[:3] for f in identifiers.find(text) if f[3]]


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(7)
    parts = ["a", "b.c", "@", "@", ".", "-", " ", "  ", "+", "%", "_", "1", "12", "255", "256", "0003", "4111111111111111", "4111 1111 1111 1111", "(555)", "é", "\n", "dot", " at ", "one "]
    some = 0
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 24)))
        assert base(text) == direct(text), text
        some += len(base(text))
    assert some > 2000
    for text in [*DISGUISED, *CLEAN]:
        assert base(text) == direct(text)


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_map_back_to_the_source(text):
    kind, source, value = DISGUISED[text]
    spans = [(identifiers.KINDS[k], text[s:e], v) for k, s, e, _, v in identifiers.find(text)]
    assert (kind, source, value) in spans


def test_clean_texts_have_none():
    assert all(not identifiers.find(text) for text in CLEAN)


def test_output_maps_every_place_back():
    rnd = random.Random(9)
    for _ in range(500):
        text = "".join(rnd.choice("abc") for _ in range(30))
        cuts = sorted(rnd.sample(range(31), 6))
        edits = [(a, b, rnd.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2])]
        sources, want, at = [], [], 0
        for a, b, put in [*edits, (30, 30, "")]:
            sources += [(i, i + 1) for i in range(at, a)] + [(a, b)] * len(put)
            want += [*text[at:a], *put]
            at = b
        output = identifiers.Output(text, edits)
        assert output.text == "".join(want)
        for i in range(len(want)):
            for j in range(i + 1, len(want) + 1):
                assert output.back(i, j) == (sources[i][0], sources[j - 1][1])


@pytest.mark.parametrize("text", ["1" * 400_000, "1 " * 200_000, "a" * 400_000 + "@", "@" * 400_000, "a at a dot " * 50_000, "one " * 100_000, " " * 400_000, "(" * 400_000, "+1" * 200_000])
def test_long_texts_take_time_in_proportion(text):
    assert base(text + " x@y.z")[-1][0] == 0


def test_report_of_odd_rows(spark):
    texts = [None, "", *DISGUISED, *CLEAN, "x a@b.cd +1 (988) 555-2485 " * 3000, "a@b.cd", "a@b.cd"]
    columns = "doc_id bigint, text string, spans int, ordinal string, start int, n_email int"
    rows = [(i if i % 5 else None, t, 1, "x", 2, 3) for i, t in enumerate(texts)]
    got = identifiers.report(identifiers.identifiers(spark.createDataFrame(rows, columns).repartition(3))).collect()
    want = []
    for i, t, *_ in rows:
        spans = [(f"{identifiers.KINDS[k]}:{s}:{e}", k, is_base) for k, s, e, is_base, _ in identifiers.find(t or "")]
        counts = [sum(k == n and is_base for _, k, is_base in spans) for n in range(4)]
        digest = hashlib.sha256(",".join(s for s, _, is_base in spans if is_base).encode()).hexdigest()
        want.append((i, *counts, digest, ",".join(s for s, *_ in spans)))
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert identifiers.report(identifiers.identifiers(spark.createDataFrame([], columns))).count() == 0
