"""Token ids as flat binary files with 64-bit document offsets, written and read by tasks.

``write`` orders documents by range partitions, so each task holds a run of doc_ids and
writes one pair of files in the shared folder:

* ``tokens-PPPPP.bin``: ids one after another, little-endian unsigned integers of the
  smallest width that holds the vocabulary;
* ``tokens-PPPPP.idx``: little-endian 64-bit integers: the number n of documents, n + 1
  offsets into the ids, n doc_ids, n flags that are 0 where the doc_id is null.

A task writes under a name of its own attempt and renames it at the end, and its content
depends on its rows alone, so lost or repeated attempts do no harm.  The manifest, a small
Parquet table, has a row a partition; the running sum of its token counts gives each
partition's base, the place of its first id in the whole sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, whole_text, worker_state
from itemloom.llm.words import WordIds

#: Characters handed to the tokenizers library at once; bounds what its results take in memory.
CALL_CHARS = 400_000
#: Where a long text may be cut: before a blank between two ASCII letters a piece always begins.
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: A blank and a word; how many of them go to the library at once.
VISIBLE, CALL_WORDS = re.compile(r" \S+"), 20_000

MANIFEST = "part bigint, file string, n_docs bigint, n_tokens bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _tokenizer(path: str) -> WordIds:
    """The tokenizers library's ids of whole texts; it encodes each word a worker has not met."""
    state = worker_state()
    key = ("tokenizer", path)
    if key not in state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        specials = {t.content: np.uint32(i).tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        state[key] = WordIds(lambda texts: _encoded_words(tokenizer, texts), specials)
    return state[key]


def _portions(text: str) -> list[str]:
    """A text of any length as portions whose ids join to the ids of the whole."""
    out, begin = [], 0
    while len(text) - begin > CALL_CHARS:
        cut = CUT.search(text, begin + CALL_CHARS // 2)
        if cut is None:
            break
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


def _encoded(tokenizer, texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The ids of each text, in order, a bounded number of characters a call."""
    held: list[tuple[int, str]] = []
    texts = list(texts)
    done: list[list[np.ndarray]] = [[] for _ in texts]
    size = 0

    def flush():
        for (at, _), encoding in zip(held, tokenizer.encode_batch_fast([t for _, t in held], add_special_tokens=False)):
            done[at].append(np.asarray(encoding.ids, np.uint32))
        held.clear()

    for at, text in enumerate(texts):
        for portion in _portions(text):
            held.append((at, portion))
            size += len(portion)
            if size >= CALL_CHARS:
                flush()
                size = 0
    flush()
    for parts in done:
        yield np.concatenate(parts) if len(parts) != 1 else parts[0]


def _encoded_words(tokenizer, texts: list[str]) -> list[bytes]:
    """As ``_encoded``, but visible words go to the library as the lines of one text.

    A line end before a blank and a visible character is a piece of its own, so its id
    parts the words' ids again.
    """
    visible = [VISIBLE.fullmatch(t) is not None for t in texts]
    lines = [t for t, plain in zip(texts, visible) if plain]
    others = _encoded(tokenizer, [t for t, plain in zip(texts, visible) if not plain])
    words: list[bytes] = []
    for begin in range(0, len(lines), CALL_WORDS):
        encoding = tokenizer.encode_batch_fast(["\n".join(lines[begin : begin + CALL_WORDS])], add_special_tokens=False)[0]
        ids = np.asarray(encoding.ids, np.uint32)
        end_of_line = tokenizer.encode("\n", add_special_tokens=False).ids[0]
        ends = np.flatnonzero(ids == end_of_line).tolist()
        data = ids.tobytes()
        words += [data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]
    parted = iter(words)
    return [next(parted) if plain else next(others).tobytes() for plain in visible]


def _file_system(folder: str):
    """Reader and writer of any shared store, and the folder's path in it."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


def _write_part(vocabulary: str, folder: str, end_id: int, dtype: str, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    context = TaskContext.get()
    part = context.partitionId()
    store, root = _file_system(folder)
    store.create_dir(root, recursive=True)
    name = f"tokens-{part:05d}"
    own = f"{root}/.{name}-{context.taskAttemptId()}"
    tokenizer = _tokenizer(vocabulary)
    sizes: list[int] = []
    ids_of: list[int] = []
    known: list[int] = []
    with store.open_output_stream(own + ".bin") as out:
        for batch in batches:
            for text in batch["text"]:
                ids = np.frombuffer(tokenizer.ids(text), np.uint32)
                out.write(np.append(ids, np.uint32(end_id)).astype(dtype).tobytes())
                sizes.append(len(ids) + 1)
            present = batch["doc_id"].notna()
            known += present.astype(int).tolist()
            ids_of += [int(x) if ok else 0 for x, ok in zip(batch["doc_id"], present)]
    index = np.concatenate([[len(sizes)], [0], np.cumsum(sizes, dtype=np.int64), ids_of, known]).astype("<i8")
    with store.open_output_stream(own + ".idx") as out:
        out.write(index.tobytes())
    for end in (".bin", ".idx"):
        store.move(own + end, f"{root}/{name}{end}")
    yield pd.DataFrame({"part": [part], "file": [name], "n_docs": [len(sizes)], "n_tokens": [sum(sizes)]})


def write(documents: DataFrame, vocabulary: str, folder: str, end_id: int = 0, width: str = "<u2") -> None:
    """Write the ids of every document, ``end_id`` after each, in ascending doc_id order.

    ``folder`` must be new and shared.  A null text has no id but the end id; documents
    without a doc_id come first; equal doc_ids stand together, ordered by their text; an
    empty table gives empty files or none.  Columns beyond doc_id and text are not read.
    ``width`` is the integers' type; "<u2" holds vocabularies up to 65,536.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = ordered.mapInPandas(lambda b: _write_part(vocabulary, folder, end_id, width, b), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")


def bases(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each partition's base: the ids of all partitions before it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_part(folder: str, file: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets, doc_ids and flags of one partition: memory-mapped where the store is a file system."""
    from pyarrow import fs

    store, root = _file_system(folder)

    def mapped(path: str, kind: str) -> np.ndarray:
        if isinstance(store, fs.LocalFileSystem) and os.path.getsize(path):
            return np.memmap(path, kind, "r")
        with store.open_input_file(path) as source:
            return np.frombuffer(source.read(), kind)

    index = mapped(f"{root}/{file}.idx", "<i8")
    n = int(index[0])
    return mapped(f"{root}/{file}.bin", dtype), index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]


def _read_parts(folder: str, dtype: str, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, base in zip(batch["file"], batch["base"]):
            ids, offsets, docs, known = open_part(folder, file, dtype)
            for begin in range(0, len(docs), 5000):
                end = min(begin + 5000, len(docs))
                crc = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(begin, end)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(docs[begin:end], dtype="Int64").where(known[begin:end] == 1),
                        "start": base + offsets[begin:end],
                        "n_tokens": np.diff(offsets[begin : end + 1]),
                        "ids_crc32": crc,
                    }
                )


def read(spark: SparkSession, folder: str, width: str = "<u2") -> DataFrame:
    """A row a document from the files: where it starts, how many ids it has, their checksum.

    One task maps one partition's files; no task and not the driver holds more than the
    manifest's few columns.
    """
    rows = bases(spark, folder).filter("n_docs > 0").select("file", "base")
    return rows.repartition("file").mapInPandas(lambda b: _read_parts(folder, width, b), ROWS)
