"""Conversation repair against whole-string searches, and bounded memory of the search."""

import hashlib
import random
import re
import zlib

from itemloom.llm import conversations
from itemloom.llm.conversations import Row, Search

RND = random.Random(5)
COLUMNS = "conv_id bigint, turn bigint, role string, text string, copies int, fault string, seen int, place int, edit string"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FULL = {"u": "user", "a": "assistant"}


def inserted(paths):
    """All ways on by insertions alone, the cheapest to each state."""
    out = dict(paths)
    for _ in range(3):
        for state, (cost, audit, lines) in list(out.items()):
            for c, role in FULL.items():
                to = NEXT[c].get(state)
                path = (cost + 3, audit + "I", (*lines, role + ":"))
                if to is not None and (to not in out or path[:2] < out[to][:2]):
                    out[to] = path
    return out


def cheapest(rows):
    """(cost, edits, repaired lines) with whole paths kept for each state."""
    paths = {0: (0, "", ())}
    for row in rows:
        after = {}
        for state, (cost, audit, lines) in inserted(paths).items():
            ways = [(state, 4, "D", ())]
            if row.fault not in ("blank", "duplicate"):
                more = 3 * (row.fault == "truncated")
                ways += [(NEXT[c][state], more, "K", (f"{row.role}:{row.text}",)) for c in NEXT if c == row.role[:1] and state in NEXT[c]]
                ways += [(NEXT[c][state], 3 + more, "R", (f"{role}:{row.text}",)) for c, role in FULL.items() if state in NEXT[c]]
            for to, price, edit, line in ways:
                path = (cost + price, audit + edit, lines + line)
                if to not in after or path[:2] < after[to][:2]:
                    after[to] = path
        paths = after
    return min((p for s, p in inserted(paths).items() if s in (0, 3)), key=lambda p: p[:2])


def shown(nodes):
    return "".join(n.edit for n in nodes), tuple(f"{n.role}:{n.text}" for n in nodes if n.role is not None)


def drawn(n, roles=("system", "user", "assistant", "user", "assistant", "tool", ""), faults=("", "", "", "blank", "duplicate", "truncated")):
    return [Row(RND.choice(roles), RND.choice("xyz"), RND.choice(faults)) for _ in range(n)]


def test_search_finds_the_least_of_the_cheapest():
    for _ in range(4000):
        rows = drawn(RND.randint(0, 14))
        search = Search()
        nodes = [n for row in rows for n in search.add(row)] + list(search.end())
        assert (search.cost, *shown(nodes)) == cheapest(rows), rows


def test_long_conversations_settle_early():
    for roles, faults in [(("system", "user", "assistant", "tool"), ("", "blank", "truncated")), (("user", "assistant"), ("",)), (("tool",), ("truncated",))]:
        search, most, nodes = Search(), 0, []
        for k, row in enumerate(drawn(5000, roles, faults)):
            nodes += search.add(row)
            most = max(most, search.unsettled()) if k % 10 == 0 else most
        assert most < 200
        nodes += search.end()
        assert re.fullmatch("s?(ua)*", "".join(n.role[0] for n in nodes if n.role is not None))


def test_a_long_undecided_conversation_ends():
    rows = [Row("tool", "x", "")] * 30_001
    search = Search()
    nodes = [n for row in rows for n in search.add(row)] + list(search.end())
    assert (search.cost, shown(nodes)[0]) == (4 + 30_000 * 3, "D" + "R" * 30_000)


def plain(rows):
    """The whole query's rows, one conversation at a time."""
    of = {}
    for conv_id, turn, role, text in rows:
        after = of.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, after in of.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, found = set(), []
        for _, role, text in after:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            found.append(Row(role, text, fault))
        turns = {t for t, _, _ in after if t is not None}
        initials = [r.role[:1] for r in found]
        cost, audit, lines = cheapest(found)
        count = lambda fault: sum(r.fault == fault for r in found)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3, "e") for r in rows], COLUMNS).repartition(5)


def odd_rows():
    texts = ["Yes.", "No", "Well?", "", " \t\n", None, "Ça va… oui!", "a. b", "x" * 100_000 + ".", "tail .  \r\n", " ", "Yes."]
    rows = [(c, t if RND.random() < 0.9 else None, RND.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), RND.choice(texts)) for c in [*range(120), None] for t in range(RND.randint(1, 9))]
    rows += RND.sample(rows, 60)
    rows += [(500, 3, "user", "Same.")] * 40 + [(501, None, None, None)] + [(502, -5, "user", "Far."), (502, 10**12, "assistant", "Away.")]
    rows += [(600, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(3000)]
    return rows


def test_query_is_that_of_plain_search(spark):
    rows = odd_rows()
    got = conversations.damaged_and_repaired(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    assert conversations.damaged_and_repaired(frame(spark, rows).limit(0)).count() == 0


def test_repaired_rows_tell_the_same_as_summaries(spark):
    rows = frame(spark, odd_rows())
    edits = {}
    for r in conversations.repaired(rows).collect():
        edits.setdefault(r["conv_id"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    found = conversations.summaries(rows).collect()
    assert len(found) == len(edits)
    for r in found:
        own = sorted(edits[r["conv_id"]], key=lambda e: e[0]) if r["audit"] else []
        lines = "\n".join(f"{role}:{text}" for _, _, role, text in own if role is not None)
        assert ("".join(e[1] for e in own), hashlib.sha256(lines.encode()).hexdigest()) == (r["audit"], r["repaired_sha256"])
