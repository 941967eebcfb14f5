"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A byte-pair encoding has the property that the tokens of a prefix are fixed by that
prefix alone: each prefix has one last token.  ``Encoder`` finds it for every prefix of a
piece.  An automaton over the vocabulary reports the tokens that end at each position
(the vocabulary's suffixes of the prefix); a candidate is right when its left neighbour,
the last token already stored for the shorter prefix, and the candidate would stay apart
under the merges.  Back-pointers then give the ids.  The cost is linear in the text.

Pieces are the vocabulary's own split of the text.  Words repeat, so each worker keeps the
ids of those it has met, up to a fixed number (``words``).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, whole_text, worker_state
from itemloom.llm.words import WordIds

#: Pairs of tokens a worker remembers; beyond it they are tested each time they are met.
REMEMBERED = 300_000

#: The vocabulary's split for texts of Latin letters (fixed values: its alternatives, up to U+024F).
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
NOT_LATIN = re.compile("[^\0-\u024f]")

ENCODED = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else 256 and up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder:
    """Exact ids of a byte-level BPE vocabulary file, and their text.

    ``ids(text)`` gives native unsigned 32-bit integers, ``text(ids)`` the text again.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self._byte_of = {ord(c): b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        self._automaton = ahocorasick.Automaton()
        self._single: dict[str, int] = {}
        for text, token in vocab.items():
            raw = text.translate(self._byte_of)  # latin-1 letters stand for bytes
            self.token_bytes[token] = raw.encode("latin-1")
            if len(raw) == 1:
                self._single[raw] = token
            else:
                self._automaton.add_word(raw, (token, len(raw)))
        self._automaton.make_automaton()
        for text, token in self.special.items():
            self.token_bytes[token] = text.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self._rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self._parts = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(merges)}
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self._apart: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.ids = WordIds(lambda texts: [self._split_ids(t) for t in texts], {t: array("I", [i]).tobytes() for t, i in self.special.items()}).ids

    # -- pairs ---------------------------------------------------------------------------------

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one end of a token while it is merged, each with the rank that ends it."""
        key = (token, side)
        found = self._edges.get(key)
        if found is None:
            found, until = [], 1 << 60
            while True:
                found.append((token, until))
                if token not in self._parts:
                    break
                left, right, until = self._parts[token]
                token = right if side else left
            self._edges[key] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """True if the merges of the two tokens' joined bytes give these two tokens again.

        They do unless some merge across the border comes due while both its symbols stand
        there.  Equal ranks go left to right: the left token's own merge wins a tie, the
        right token's loses it.
        """
        for a, a_until in self._edge(left, 1):
            for b, b_until in self._edge(right, 0):
                due = self._rank.get((a, b))
                if due is not None and due < a_until and due <= b_until:
                    return False
        return True

    # -- pieces --------------------------------------------------------------------------------

    def piece_ids(self, raw: str) -> list[int]:
        """Ids of one piece, given as latin-1 letters: one last token for every prefix, then back.

        The automaton names the longer tokens first.  Where none of two bytes or more fits,
        the single byte is the prefix's last token, since each prefix has exactly one.
        """
        n = len(raw)
        last = [0, *map(self._single.__getitem__, raw)]
        start = list(range(-1, n))
        apart, settled = self._apart, -1
        for end, (token, length) in self._automaton.iter(raw):
            if end == settled:
                continue
            begin = end + 1 - length
            if begin:
                left = last[begin]
                fits = apart.get(left << 20 | token)
                if fits is None:
                    fits = self.compatible(left, token)
                    if len(apart) < REMEMBERED:
                        apart[left << 20 | token] = fits
                if not fits:
                    continue
            last[end + 1], start[end + 1], settled = token, begin, end
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        ids.reverse()
        return ids

    def split(self, text: str) -> list[str]:
        """The vocabulary's pieces of a text, as latin-1 letters."""
        if NOT_LATIN.search(text):
            return [piece.translate(self._byte_of) for piece, _ in self._split(text)]
        pieces = LATIN_SPLIT.findall(text)
        return pieces if text.isascii() else [p.encode().decode("latin-1") for p in pieces]

    def _split_ids(self, text: str) -> bytes:
        out = array("I")
        for piece in self.split(text):
            out.extend(self.piece_ids(piece))
        return out.tobytes()

    def text(self, ids: bytes | np.ndarray) -> str:
        """Text of ids: bytes that are no UTF-8 become replacement characters."""
        table = self.token_bytes
        return b"".join([table[i] for i in memoryview(ids).cast("B").cast("I")]).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, built once."""
    state = worker_state()
    key = ("encoder", path)
    if key not in state:
        state[key] = Encoder(path)
    return state[key]


def little_endian(ids: bytes) -> bytes:
    return np.frombuffer(ids, np.uint32).astype("<u4", copy=False).tobytes()


def _rows(path: str, batches: Iterable[pd.DataFrame], digests: bool) -> Iterator[pd.DataFrame]:
    enc = encoder(path)
    for batch in batches:
        n, first, second = [], [], []
        for text in batch["text"]:
            ids = enc.ids(text)
            decoded = enc.text(ids)
            n.append(len(ids) // 4)
            ids = little_endian(ids)
            first.append(hashlib.sha256(ids).hexdigest() if digests else ids)
            second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
        names = DIGESTS if digests else ENCODED
        yield pd.DataFrame(dict(zip((c.split()[0] for c in names.split(", ")), (batch["doc_id"], n, first, second))))


def encode(documents: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Encode and decode every text: a row a document, nothing moves between executors.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's JSON,
    found at that path on every executor.  Returns doc_id, n_tokens, ids (little-endian
    unsigned 32-bit) and decoded; with ``digests`` SHA-256 of the last two in their place.

    A null text counts as empty and gives no ids; a null doc_id stays; repeated rows give
    repeated rows; other columns of ``documents``, whatever their names, are not read.  A
    special token's string in a text is that token, as the library has it.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(lambda batches: _rows(vocabulary, batches, digests), DIGESTS if digests else ENCODED)
