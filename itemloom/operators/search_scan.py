"""Search in the documents' own texts: each search reads them in one pass, nothing but its terms is stored or moved.

``store`` writes a row a document with its fields' texts.  A search's distinct terms (``SENT_ROWS``
tokens at most) go to every task as classes of tokens: a token, a stem, or a beginning.  A task cuts
a piece of documents into tokens, looks each distinct one up, and meets phrases as neighbours of a
phrase's first two classes whose further tokens are in place.  What is found of a document is one
row at once, so terms, places and candidates are never moved by key.  Prefixes and stems are met
in the pieces' own tokens, so no vocabulary is needed either.

The methods are those of ``search_index.Index``, whose stored postings suit many small searches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from itemloom.functions import text as tx
from itemloom.functions.stemming import stem_word
from itemloom.operators import search as X
from itemloom.operators import search_index as I
from itemloom.operators.search_index import FIELD_BITS, PIECE_CHARS, _counted_tokens, _pieces, _spanned_tokens  # by name: task functions take no module along
from itemloom.session import bounded_batches, shuffles_removed, stored

#: Bytes of texts in a row group of the stored texts, so that a scan can be dealt to tasks; stems a task remembers.
GROUP_BYTES, REMEMBERED = 8 << 20, 500_000
#: Of so many documents one is ranked first, for a bar that all others are held to.
FIRST_SHARE = 16

_FOUND = "doc_id {}, doc_len int, terms array<bigint>, fs array<double>"
_PLACED = "doc_id {}, term bigint, starts array<bigint>"
_STARTED = "form string, token string"


@dataclass
class Lexicon:
    """Terms by number, and the classes of tokens that they are made of."""

    names: list[str]
    stemmed: bool
    whole: dict[str, int] = field(default_factory=dict)
    leads: dict[int, dict[str, int]] = field(default_factory=dict)
    #: Classes of each term's tokens.
    classes: list[list[int]] = field(default_factory=list)

    def numbers(self, spark: SparkSession) -> DataFrame:
        """name, term and n_tokens."""
        rows = [(name, t, len(cs)) for t, (name, cs) in enumerate(zip(self.names, self.classes))]
        return spark.createDataFrame(rows, "name string, term bigint, n_tokens int")

    def tables(self) -> _Tables:
        return _Tables(self)


class _Tables:
    """A lexicon as arrays: terms of a class, terms of a pair of classes, and the classes that a term still needs."""

    def __init__(self, lexicon: Lexicon):
        classes = lexicon.classes
        self.k = 1 + max((c for cs in classes for c in cs), default=0)
        self.sizes = np.array([len(cs) for cs in classes], np.int64)
        self.needs = np.zeros((len(classes), max(self.sizes, default=0)), np.int64)
        for t, cs in enumerate(classes):
            self.needs[t, : len(cs)] = cs
        one, more = np.flatnonzero(self.sizes == 1), np.flatnonzero(self.sizes > 1)
        self.single = _grouped(self.needs[one, 0], one) if len(one) else _grouped(one, one)
        pairs = self.needs[more, 0] * self.k + self.needs[more, 1] if len(more) else more
        self.pairs = _grouped(pairs, more)
        self.opens = np.zeros(self.k, bool)
        self.opens[self.needs[more, 0] if len(more) else more] = True


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where the values of each begin (and the last end), and the values."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct, np.r_[first, len(keys)], values[order]


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``count`` values from ``first`` on: each value's row, and the values."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def _met(keys: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``keys`` and the values grouped under them."""
    distinct, first, values = groups
    if not len(distinct) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
    held = np.flatnonzero(distinct[at] == keys)
    row, value = _ranges(first[at[held]], first[at[held] + 1] - first[at[held]])
    return held[row], values[value]


def lexicon(asked: DataFrame, stemmed: bool = False, of: str = "true") -> Lexicon | None:
    """The terms of ``asked`` whose tokens meet the condition ``of``; None of more than ``I.SENT_ROWS`` tokens."""
    rows = I.term_tokens(asked).where(of).limit(I.SENT_ROWS + 1).collect()
    if len(rows) > I.SENT_ROWS:
        return None
    out = Lexicon(sorted({r["term"] for r in rows}), stemmed)
    number = {name: t for t, name in enumerate(out.names)}
    out.classes = [[] for _ in out.names]
    made: dict[tuple[str, bool], int] = {}
    for r in sorted(rows, key=lambda r: (r["term"], r["offset"])):
        form = stem_word(r["token"]) if stemmed else r["token"]
        own = made.setdefault((form, r["is_prefix"]), len(made))
        (out.leads.setdefault(len(form), {}) if r["is_prefix"] else out.whole)[form] = own
        out.classes[number[r["term"]]].append(own)
    return out


def _classes(words: list[str], lexicon_: Lexicon, stems: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` and the classes that the words are in."""
    at, own = [], []
    whole, leads = lexicon_.whole, list(lexicon_.leads.items())
    for i, word in enumerate(words):
        if lexicon_.stemmed:
            form = stems.get(word)
            if form is None:
                form = stem_word(word)
                if len(stems) < REMEMBERED:
                    stems[word] = form
        else:
            form = word
        if (c := whole.get(form)) is not None:
            at.append(i)
            own.append(c)
        for k, by in leads:
            if (c := by.get(form[:k])) is not None:
                at.append(i)
                own.append(c)
    return np.array(at, np.int64), np.array(own, np.int64)


@dataclass
class _Piece:
    """A piece's tokens: codes of distinct words, the run (a document's field) of each, and where runs begin."""

    ids: pa.Array
    words: list[str]
    code: np.ndarray
    run: np.ndarray
    runs: np.ndarray
    n_fields: int

    def lengths(self) -> np.ndarray:
        return np.diff(self.runs[:: self.n_fields])


def _tokenised(batches: Iterable[pa.RecordBatch], folding: dict[int, int], n_fields: int) -> Iterator[_Piece]:
    for batch in batches:
        chars = pc.utf8_length(batch.column("bodies").flatten()).to_numpy(zero_copy_only=False).reshape(-1, n_fields).sum(axis=1)
        for piece in _pieces(batch, chars, PIECE_CHARS):
            bodies = piece.column("bodies").flatten().to_pylist()
            tokens, _, _, sizes = _counted_tokens(bodies, folding) or _spanned_tokens(bodies, folding)
            words = tokens.dictionary_encode()
            run = np.repeat(np.arange(len(sizes)), sizes)
            yield _Piece(piece.column("doc_id"), words.dictionary.to_pylist(), words.indices.to_numpy(), run, np.r_[0, np.cumsum(sizes)], n_fields)


def _hits(piece: _Piece, lexicon_: Lexicon, tables: _Tables, stems: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the piece, and the term that begins at each."""
    n, code, run = len(piece.code), piece.code, piece.run
    at, own = _classes(piece.words, lexicon_, stems)
    first = np.searchsorted(at, np.arange(len(piece.words) + 1))
    pos, value = _ranges(first[code], first[code + 1] - first[code])
    cls = own[value]
    row, single = _met(cls, tables.single)
    # Neighbours in one run: rows of a phrase's first class with all rows of the next place.
    opening = np.flatnonzero(tables.opens[cls] & (pos + 1 < n)) if len(cls) else np.zeros(0, np.int64)
    opening = opening[run[pos[opening]] == run[pos[opening] + 1]] if len(opening) else opening
    begins = np.searchsorted(pos, np.arange(n + 1))
    after = pos[opening] + 1
    left, right = _ranges(begins[after], begins[after + 1] - begins[after])
    left = opening[left]
    pair, phrase = _met(cls[left] * tables.k + cls[right], tables.pairs)
    start = pos[left[pair]]
    held = np.sort(pos * tables.k + cls)
    for k in range(2, tables.needs.shape[1]):
        longer = np.flatnonzero(tables.sizes[phrase] > k)
        if not len(longer):
            break
        there = np.minimum(start[longer] + k, n - 1)
        inside = (start[longer] + k < n) & (run[there] == run[start[longer]])
        key = there * tables.k + tables.needs[phrase[longer], k]
        found = np.minimum(np.searchsorted(held, key), len(held) - 1)
        kept = np.ones(len(phrase), bool)
        kept[longer] = inside & (held[found] == key)
        start, phrase = start[kept], phrase[kept]
    return np.r_[pos[row], start], np.r_[single, phrase]


def _found_rows(schema: pa.Schema, lexicon_: Lexicon, weights: Sequence[float], pieces: Iterable[_Piece]) -> Iterator[pa.RecordBatch]:
    tables, stems, weight = lexicon_.tables(), {}, np.array(weights)
    for piece in pieces:
        place, term = _hits(piece, lexicon_, tables, stems)
        run = piece.run[place]
        key, which = np.unique(run // piece.n_fields * len(lexicon_.names) + term, return_inverse=True)
        f = np.bincount(which, weight[run % piece.n_fields], len(key))
        bounds = np.searchsorted(key, np.arange(len(piece.ids) + 1) * len(lexicon_.names))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
        terms = lists(pa.array(key % max(1, len(lexicon_.names)), pa.int64()))
        yield pa.record_batch([piece.ids, pa.array(piece.lengths(), pa.int32()), terms, lists(pa.array(f, pa.float64()))], schema=schema)


def _placed_rows(schema: pa.Schema, lexicon_: Lexicon, pieces: Iterable[_Piece]) -> Iterator[pa.RecordBatch]:
    tables, stems = lexicon_.tables(), {}
    for piece in pieces:
        place, term = _hits(piece, lexicon_, tables, stems)
        run = piece.run[place]
        key = run // piece.n_fields * len(lexicon_.names) + term
        order = np.lexsort((place, key))
        key, place, run = key[order], place[order], run[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        starts = (run % piece.n_fields).astype(np.int64) << FIELD_BITS | place - piece.runs[run]
        held = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), pa.array(starts, pa.int64()))
        owner, term = pa.array(key[first] // max(1, len(lexicon_.names))), pa.array(key[first] % max(1, len(lexicon_.names)), pa.int64())
        yield pa.record_batch([piece.ids.take(owner), term, held], schema=schema)


def _started_rows(schema: pa.Schema, lexicon_: Lexicon, pieces: Iterable[_Piece]) -> Iterator[pa.RecordBatch]:
    form = {c: lead for by in lexicon_.leads.values() for lead, c in by.items()}
    for piece in pieces:
        met = [(form[c], piece.words[i]) for i, c in zip(*map(np.ndarray.tolist, _classes(piece.words, lexicon_, {}))) if c in form]
        yield pa.record_batch([pa.array([x for x, _ in met], pa.string()), pa.array([x for _, x in met], pa.string())], schema=schema)


@dataclass(frozen=True)
class Texts:
    """Stored documents: doc_id and bodies, an array of the fields' texts."""

    documents: DataFrame
    n_fields: int = len(X.FIELD_WEIGHTS)

    def _scan(self, documents: DataFrame, out: str, rows: Callable, *given) -> DataFrame:
        spark = documents.sparkSession
        bounded_batches(spark)
        out = out.format(documents.schema["doc_id"].dataType.simpleString())
        schema, folding, n_fields = to_arrow_schema(T._parse_datatype_string(out)), str.maketrans(*tx.folding()), self.n_fields
        # Sent with the function, by value: a broadcast's class would have to be installed where tasks run.
        return documents.select("doc_id", "bodies").mapInArrow(lambda batches: rows(schema, *given, _tokenised(batches, folding, n_fields)), out)

    def terms_and_parts(self, queries: DataFrame, stemmed: bool = False, weights: Mapping[str, float] = X.FIELD_WEIGHTS) -> tuple[DataFrame, Lexicon, I.Scored]:
        """(asked, lexicon, scored): the terms and what was found of them, as ``search_index.terms_and_parts`` has them."""
        asked = stored(I.asked_terms(queries), "search-terms")
        words = lexicon(asked, stemmed)
        if words is None:
            raise ValueError(f"more than {I.SENT_ROWS} tokens are asked for: search an index")
        return asked, words, self.gathered(words, weights)

    def gathered(self, words: Lexicon, weights: Mapping[str, float] = X.FIELD_WEIGHTS) -> I.Scored:
        found = stored(self._scan(self.documents, _FOUND, _found_rows, words, list(weights.values())), "search-frequencies")
        n_docs, n_tokens = found.agg(F.count(F.lit(1)), F.sum(F.col("doc_len").cast("bigint"))).first()
        norm = X.K1 * (1 - X.B + X.B * F.col("doc_len") / F.lit(n_tokens / n_docs if n_tokens else 1.0))
        documents = found.where(F.size("terms") > 0).select("doc_id", I.block_of(F.col("doc_id"), F.col("doc_len")).alias("block"), norm.alias("norm"), "terms", "fs")
        per_term = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = words.numbers(self.documents.sparkSession).drop("n_tokens").join(per_term, "term").withColumn("idf", F.when(raw > 0, raw).otherwise(1e-6))
        return I.Scored(documents, stored(terms, "search-idf"))

    def occurrences(self, words: Lexicon, documents: DataFrame | None = None) -> DataFrame:
        """term (its name), doc_id, n_tokens and starts of every term in every document, or in ``documents``."""
        placed = self._scan(self.documents if documents is None else documents, _PLACED, _placed_rows, words)
        names = words.numbers(placed.sparkSession)
        return placed.join(F.broadcast(names), "term").select(F.col("name").alias("term"), "doc_id", "n_tokens", "starts")

    def started(self, words: Lexicon) -> DataFrame:
        """form and token: the distinct tokens that begin with a form some prefix has."""
        return self._scan(self.documents, _STARTED, _started_rows, words).distinct()

    def on_page(self, page: DataFrame) -> Texts:
        """The documents of a page alone, with their tokens' places: as many as the page has, whatever the table."""
        ids = stored(page.select("doc_id").distinct(), "search-page-ids")
        ids = F.broadcast(ids) if ids.count() <= I.SENT_ROWS else ids
        chosen = self.documents.join(ids, "doc_id", "left_semi")
        names = list(X.FIELD_WEIGHTS)
        rows = chosen.select("doc_id", *[F.get("bodies", F.lit(i)).alias(name) for i, name in enumerate(names)])
        return Texts(stored(I.indexed_documents(rows, names), "search-page-documents"), self.n_fields)

    def hit_windows(self, asked: DataFrame, words: Lexicon, page: DataFrame) -> DataFrame:
        """The window of every (query_id, doc_id) of a page, of which this has the documents."""
        wanted = page.select("query_id", "doc_id").join(asked.select("query_id", "term_no", "term"), "query_id")
        rows = wanted.join(self.occurrences(words), ["term", "doc_id"]).select("query_id", "doc_id", "term_no", "n_tokens", F.explode("starts").alias("place"))
        return X.best_windows(rows.select("query_id", "doc_id", "term_no", "n_tokens", *I.field_and_start(F.col("place"))))

    def snippets(self, asked: DataFrame, words: Lexicon, page: DataFrame) -> DataFrame:
        of = self.on_page(page)
        return I.snippets(of, of.hit_windows(asked, words, page))


def store(documents: DataFrame, folder: str, fields: Sequence[str] = tuple(X.FIELD_WEIGHTS)) -> None:
    """Write the documents' fields once."""
    bodies = documents.select("doc_id", F.array(*[F.coalesce(f, F.lit("")) for f in fields]).alias("bodies"))
    with shuffles_removed(documents.sparkSession):
        bodies.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(folder)


def read(spark: SparkSession, folder: str) -> Texts | None:
    """The stored texts; None where ids repeat, whose rows only an index brings together."""
    documents = spark.read.parquet(folder)
    with shuffles_removed(spark):
        unique = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return Texts(documents) if unique else None


def top(hits: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The best ``k`` documents a query of all ``hits`` (query_id, doc_id, score); the smaller doc_id first where rounded scores agree.

    The k-th score among one document in ``FIRST_SHARE`` is a bar that the best of all reach, so no task sorts all it finds.
    """
    rounded = hits.withColumn("score", F.round("score", digits))
    first = X.top_hits(rounded.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_SHARE)) == 0), k)
    bar = stored(first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar")), "search-bars")
    near = rounded.join(F.broadcast(bar), "query_id", "left").where(F.col("bar").isNull() | (F.col("score") <= F.col("bar")))
    return X.top_hits(near.drop("bar"), k)
