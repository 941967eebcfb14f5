"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

A text's features are the distinct character n-grams it holds, hashed into a fixed number
of buckets.  Each feature is scaled by its naive Bayes log-count ratio, the logarithm of
how much more often toxic training texts hold it than the others, and a logistic
regression is fitted over the scaled features.  Its score is a probability.

The fit uses a sample of at most ``SAMPLE`` labelled rows, the ones with the smallest hash
of their doc_id, and runs in one task over that bounded sample; its result is a table of
``BUCKETS`` weights, whatever the size of the corpus.  Scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, whole_text

#: At most so many labelled rows are used to fit.
SAMPLE = 5_000
#: N-gram lengths in UTF-8 bytes of the lower-cased text, and the buckets they are hashed into.
LENGTHS, BUCKETS = (4, 5), 1 << 20
#: Rows from which labels may be learnt have another remainder than this of crc32(doc_id) by FOLDS.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Fewest sample texts that hold a feature of the fit, additive smoothing of their counts,
#: weight of the squared norm, step size and number of steps.
LEAST_TEXTS, SMOOTHING, RIDGE, RATE, STEPS = 5, 0.1, 1e-3, 0.02, 60
#: Texts whose features are worked on at once.
BLOCK = 128

SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are kept away from the fit; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending; short texts have few or none."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint64)
    found = []
    for n in LENGTHS:
        if len(data) >= n:
            code = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | data[k : len(data) - n + 1 + k]
            code = (code ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((code >> np.uint64(44)).astype(np.int32))
    if not found:
        return np.zeros(0, np.int32)
    all_ = np.sort(np.concatenate(found))
    return all_[np.concatenate([[True], all_[1:] != all_[:-1]])]


def fit(texts: Iterable[str], labels: Iterable[int]) -> tuple[np.ndarray, float]:
    """Weights of the buckets, with the ratios multiplied in, and the intercept."""
    return fit_rows([buckets(t) for t in texts], np.asarray(list(labels), np.float64))


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """``fit`` over the texts' buckets, which it takes out of the list: beside them it holds a block's arrays."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(prior / (1 - prior)))
    weights = np.zeros(BUCKETS, np.float32)
    if not len(y) or y.min() == y.max():
        return weights, intercept
    held, of_toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.float64)
    for row, label in zip(rows, y):  # a row's buckets are distinct
        held[row] += 1
        of_toxic[row] += label
    kept = np.flatnonzero(held >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    blocks, sizes = [], []
    while rows:
        some = [p[p >= 0] for p in (place[r] for r in rows[:BLOCK])]
        del rows[:BLOCK]
        blocks.append(np.concatenate(some))
        sizes.append(np.array([len(p) for p in some]))
    if not sum(map(len, blocks)):
        return weights, intercept
    toxic = of_toxic[kept]
    other = held[kept] - toxic
    # Smoothing in proportion to the classes leaves a feature that tells nothing at a ratio of nought.
    ratio = np.log((toxic / y.mean() + SMOOTHING) / (other / (1 - y.mean()) + SMOOTHING))
    scale = ratio.astype(np.float32)
    # Adam on the mean log loss with a ridge; the whole sample in each step.
    w = np.zeros(len(kept), np.float32)
    first, second, b, b_first, b_second = np.zeros_like(w), np.zeros_like(w), intercept, 0.0, 0.0
    for step in range(1, STEPS + 1):
        scaled, grad, errors = w * scale, np.zeros(len(kept)), []
        for features, size, block in zip(blocks, sizes, np.split(y, range(BLOCK, len(y), BLOCK))):
            margins = np.full(len(size), b)
            if len(features):
                begins = np.minimum(np.cumsum(size) - size, len(features) - 1)
                margins += np.where(size > 0, np.add.reduceat(scaled[features], begins), 0.0)
            error = (1 / (1 + np.exp(-np.clip(margins, -40, 40))) - block).astype(np.float32)
            grad += np.bincount(features, np.repeat(error, size) * scale[features], len(kept))
            errors.append(error)
        error = np.concatenate(errors)
        grad = grad / len(y) + RIDGE * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        b_first, b_second = 0.9 * b_first + 0.1 * error.mean(), 0.999 * b_second + 0.001 * error.mean() ** 2
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= (rate * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
        b -= rate * b_first / (np.sqrt(b_second) + 1e-8)
    weights[kept] = w * ratio
    return weights, float(b)


def score(text: str, weights: np.ndarray, intercept: float) -> float:
    margin = float(weights[buckets(text)].sum(dtype=np.float64)) + intercept
    return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most ``sample`` labelled rows outside the held-out fold.

    A doc_id labelled twice counts as toxic if one label says so; of repeated documents one
    is used.  The chosen labels are at most ``sample`` short rows, so they are broadcast.
    """
    usable = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit in one task over the bounded sample; the driver gets the non-zero weights."""

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Texts are left behind batch by batch.
        found = [(i, toxic, buckets(text)) for batch in batches for i, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"])]
        found.sort(key=lambda row: row[0])
        y, rows = np.array([row[1] for row in found], np.float64), [row[2] for row in found]
        found.clear()
        weights, intercept = fit_rows(rows, y)
        at = np.flatnonzero(weights).astype(np.int32)
        yield pd.DataFrame({"at": [at.tobytes()], "weights": [weights[at].tobytes()], "intercept": [intercept]})

    bounded_batches(documents.sparkSession)
    rows = training_rows(documents, labels, sample).repartition(1)
    fitted = rows.mapInPandas(task, "at binary, weights binary, intercept double").first()
    weights = np.zeros(BUCKETS, np.float32)
    if fitted is None:  # Spark plans no task for what it knows to be empty
        return fit([], [])
    weights[np.frombuffer(bytes(fitted["at"]), np.int32)] = np.frombuffer(bytes(fitted["weights"]), np.float32)
    return weights, fitted["intercept"]


def toxicity(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, over whole texts.

    A null text is scored as an empty one, which gets the intercept's score; a null doc_id
    stays; repeated rows are scored alike; labels, lang, source and doc_id play no part.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, intercept = shared.value
        for batch in batches:
            scores = np.array([score(t, weights, intercept) for t in batch["text"]], np.float64)
            yield batch[["doc_id", "held_out"]].assign(score=scores, predicted=(scores >= THRESHOLD).astype(np.int32))

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("text"))
    return own.mapInPandas(rows, SCORED)


def without_toxic(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows whose texts are not predicted toxic, with all their columns."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = documents.columns

    def verdicts(texts: pd.Series) -> pd.Series:
        weights, intercept = shared.value
        return texts.map(lambda t: score(t or "", weights, intercept) < THRESHOLD)

    clean = F.pandas_udf(verdicts, "boolean")
    return documents.filter(clean(whole_text())).select(*[F.col(f"`{n}`") for n in names])
