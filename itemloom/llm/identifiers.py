"""Personal identifiers in plain and disguised form, with spans in the source's own characters.

Transducers of three sorts read a text one after the other.  Each copies what none of its rules
takes, writes a rule's output for what it takes, and records where output and input part:

* characters: homoglyphs, other scripts' digits, dashes and blanks become ASCII, invisible
  characters nothing;
* digits: runs of digit words become digits, letters that stand for one between two digits
  too, ``plus`` before a digit becomes ``+``;
* signs: ``(at)``, ``[dot]``, ``at`` and ``dot`` between names become ``@`` and ``.``.

The same detectors run over the source, whose map is the identity, and over the last
output; spans of the output go back through their records to source characters.
Every step takes time in proportion to the text, so texts may have any length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, whole_text, worker_state

#: The kinds, in the order of the report.
KINDS = ("email", "ip", "card", "phone")
FOUND = "doc_id bigint, spans array<struct<ordinal: int, start: bigint, end: bigint, base: boolean, value: string>>"

#: Letters of other scripts beside the ASCII ones they look like.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухѕіјԁһӏԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι" "。։∙·•",
        "ABEKMHOPCTYXSIJaeopcyxsijdhlqw" "ABEZHIKMNOPTYXovi" ".:...",
    )
)
#: The words for 0 to 9 in English, German, French and Spanish.
DIGIT_WORDS = {
    word: str(digit)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(line.split())
} | {"oh": "0"}
#: Words for ``@``, for ``.`` and for ``+``.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arobase", "arroba"), ("dot", "punkt", "point", "punto"), ("plus", "más")

Edit = tuple[int, int, str]


class Output:
    """What a transducer wrote, and the way back from its places to those of what it read."""

    def __init__(self, text: str, edits: Iterable[Edit]):
        parts, at, shift = [], 0, 0
        self._begins, self._ends, self._sources = [], [], []
        for start, end, put in edits:
            parts += (text[at:start], put)
            begin = start + shift
            self._begins.append(begin)
            self._ends.append(begin + len(put))
            self._sources.append((start, end))
            shift += len(put) - (end - start)
            at = end
        self.changed = bool(parts)
        self.text = "".join([*parts, text[at:]]) if parts else text

    def _source(self, place: int) -> tuple[int, int]:
        """Where the character at ``place`` comes from: a copied one from one character, a written one from all its rule took."""
        k = bisect_right(self._begins, place) - 1
        if k < 0:
            return place, place + 1
        if place < self._ends[k]:
            return self._sources[k]
        start = self._sources[k][1] + place - self._ends[k]
        return start, start + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start)[0], self._source(end - 1)[1]


def plain(char: str) -> str:
    """The ASCII that a character stands for; itself where it stands for none."""
    if char < "\x80":
        return char
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    kind = unicodedata.category(char)
    if kind == "Nd":
        return str(unicodedata.decimal(char))
    if kind in ("Cf", "Zs", "Pd"):
        return {"Cf": "", "Zs": " ", "Pd": "-"}[kind]
    folded = unicodedata.normalize("NFKC", char)
    return folded if folded.isascii() and folded.isprintable() else char


def characters(text: str) -> Iterator[Edit]:
    disguised = [c for c in set(text) if plain(c) != c] if not text.isascii() else []
    if disguised:
        for m in re.finditer("[" + "".join(map(re.escape, disguised)) + "]", text):
            yield m.start(), m.end(), plain(m[0])


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_WORD = re.compile(r"[^\W\d_]+")
_DIGIT_WORD, _DOT_WORD = _any(DIGIT_WORDS), _any(DOT_WORDS)
#: What joins digit words: a blank, a hyphen, or a dot in any form.
_JOINS = rf"(?:[ -]|[ ]?(?:\.|[\[({{<]{_DOT_WORD}[\])}}>])[ ]?|[ ]{_DOT_WORD}[ ])"
_JOINED = re.compile(rf"(?i)(?<![^\W_])(?:{_DIGIT_WORD}|[0-9]+)(?:{_JOINS}(?:{_DIGIT_WORD}|[0-9]+))+(?![^\W_])")
#: Letters that look like a digit, where they stand between two.
LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_LETTER_DIGIT = re.compile(r"[OolI](?<=[0-9].)(?=[0-9])")
_PLUS = re.compile(rf"(?i)(?<![^\W_]){_any(PLUS_WORDS)}[ ]?(?=[0-9])")


def _digit_pairs() -> ahocorasick.Automaton:
    """The worker's automaton that finds a digit word followed by another, or by what may be a dot: ``digits`` has work in no other text."""
    state = worker_state()
    if "digit pairs" in state:
        return state["digit pairs"]
    automaton = state["digit pairs"] = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for word in DIGIT_WORDS:
        for mark in " -.":
            for other in DIGIT_WORDS:
                automaton.add_word(word + mark + other)
            for digit in "0123456789":
                automaton.add_word(word + mark + digit)
                automaton.add_word(digit + mark + word)
        for mark in (*"[({<", " [", " (", " {", " <", " .", ". ", *(f" {dot}" for dot in DOT_WORDS)):
            automaton.add_word(word + mark)
    automaton.make_automaton()
    return automaton


def digits(text: str) -> Iterator[Edit]:
    """Digit words beside others or beside digits: each a digit, the blanks or hyphens between them gone; dots stay for ``signs``."""
    if next(_digit_pairs().iter(text.lower()), None) is None:
        return
    for run in _JOINED.finditer(text):
        at = None
        for word in _WORD.finditer(text, run.start(), run.end()):
            digit = DIGIT_WORDS.get(word[0].lower())
            if digit is None:
                at = None
                continue
            if at is not None and text[at : word.start()] in (" ", "-"):
                yield at, word.start(), ""
            yield word.start(), word.end(), digit
            at = word.end()


def letters(text: str) -> Iterator[Edit]:
    for m in _LETTER_DIGIT.finditer(text):
        yield m.start(), m.end(), LETTER_DIGITS[m[0]]


def pluses(text: str) -> Iterator[Edit]:
    lower = text.lower()
    if any(word in lower for word in PLUS_WORDS):
        for m in _PLUS.finditer(text):
            yield m.start(), m.end(), "+"


def _framed(words: Iterable[str]) -> str:
    """A word in brackets, blanks allowed on either side of each, after a name."""
    return rf"[\[({{< ](?<=[A-Z0-9].)(?:(?<! )|[ ]?[\[({{<])[ ]?{_any(words)}[ ]?[\])}}>][ ]{{0,2}}"


_SPELLED_DOT = rf"(?:[ ]{{0,2}}[\[({{<][ ]?{_DOT_WORD}[ ]?[\])}}>][ ]{{0,2}}|[ _]{_DOT_WORD}[ _])"
#: The last part of a name in a wholly bare disguise: two letters, or one of these fixed values.
_LAST = r"(?:[A-Z]{2}|com|net|org|edu|gov|mil|int|info|biz|name|dev|app)(?![A-Z0-9-])"
#: An ``@`` with blanks around it counts before a name with a last part in letters.  A bare ``at`` counts only before a name whose spelled dots lead to such a last part, as prose is full of it.
_SIGN = re.compile(
    rf"(?i)(?:(?P<at>{_framed((*AT_WORDS, '@'))}|[ ](?<=[A-Z0-9].)@[ ]?(?=[A-Z0-9-]{{1,63}}[.][A-Z])|[ _](?<=[A-Z0-9].){_any(AT_WORDS)}[ _](?=[A-Z0-9-]{{1,63}}(?:{_SPELLED_DOT}[A-Z0-9-]{{1,63}}){{0,3}}{_SPELLED_DOT}{_LAST}))"
    rf"|(?:{_framed((*DOT_WORDS, '[.]'))}|[ _](?<=[A-Z0-9].){_DOT_WORD}[ _]))(?=[A-Z0-9])"
)
_FRAME = re.compile(rf"(?i)[\[({{<][ ]?(?:{_any(AT_WORDS)}|[@.])[ ]?[\])}}>]")


def signs(text: str) -> Iterator[Edit]:
    lower = text.lower()
    if any(word in lower for word in (*DOT_WORDS, " @")) or _FRAME.search(text):
        for m in _SIGN.finditer(text):
            yield m.start(), m.end(), "@" if m["at"] else "."


#: Read in this order.
TRANSDUCERS: tuple[Callable[[str], Iterator[Edit]], ...] = (characters, letters, digits, signs, pluses)

#: The identifiers' patterns.  Each is written so that a place is read once or
#: twice: an e-mail's name is found backwards from its sign, an address begins a run of digits.
_NAME_BEFORE, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9][0-9]*+(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and _NAME_BEFORE.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            done = domain.end()
            yield start, done
        sign = text.find("@", max(done, sign + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part) < 4 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            yield m.span()


def luhn(number: str) -> bool:
    doubled = sum(int(d) * 2 - 9 * (d > "4") for d in number[-2::-2])
    return (doubled + sum(map(int, number[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            number = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(number) <= 19 and luhn(number):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


DETECTORS = (emails, addresses, cards, phones)


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind's ordinal, start, end, base, value) of a text's identifiers, in that order.

    Base ones stand in the source as they are; the others only in the transducers' output.
    """
    found = {(k, *span): (True, text[slice(*span)]) for k, detect in enumerate(DETECTORS) for span in detect(text)}
    outputs, last = [], text
    for transduce in TRANSDUCERS:
        output = Output(last, transduce(last))
        if output.changed:
            outputs.append(output)
            last = output.text
    if outputs:
        for k, detect in enumerate(DETECTORS):
            for start, end in detect(last):
                span = start, end
                for output in reversed(outputs):
                    span = output.back(*span)
                found.setdefault((k, *span), (False, last[start:end]))
    return sorted((*key, *rest) for key, rest in found.items())


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = "ordinal start end base value".split()
    for batch in batches:
        spans = [[dict(zip(names, span)) for span in find(text)] for text in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})


def identifiers(documents: DataFrame) -> DataFrame:
    """doc_id and spans of every row: kind's ordinal, start, end, whether base, and the plain value.

    Places are code points of the source, end exclusive.  A null text counts as empty and
    has no spans; a null doc_id stays; repeated rows give repeated rows; an empty table gives
    none; other columns, whatever their names, are not read.  A text of any length is read
    whole, in time in proportion to it.  Nothing moves between executors.
    """
    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInPandas(_rows, FOUND)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["ordinal"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans by kind and start, of ``identifiers``' rows."""
    base = F.filter("spans", lambda s: s["base"])

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["ordinal"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
