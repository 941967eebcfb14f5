"""Near-duplicate vectors by randomised-rotation binary codes and exact recomputation.

A unit vector o is rotated by a seeded random rotation and kept as the signs of its
components, a corner of the cube, with its correction factor f, the inner product of o and
that corner.  For a rotated unit vector q, (corner . q) / f estimates o . q without bias,
and lies within WIDTH standard errors, sqrt((1 - f^2) / f^2 / (d - 1)), of it.  A pair whose
estimate plus that bound stays below the threshold is left out; every other pair's cosine is
computed again in double precision, so no link is below the threshold.

Pairs that meet are those whose codes agree in one of several bands of bits.  The bits of a
band follow from the number of vectors, so a band's cell holds about CELL unrelated vectors
at any size; the number of bands follows from the wanted recall at the threshold.  A pair
counts in the first band that it shares.  Cells that hold more are split into blocks, and
tasks get pairs of blocks; a task returns sums and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.components import components
from itemloom.llm.shared import bounded_batches, materialised

THRESHOLD, RECALL, WIDTH, SEED = 0.9, 0.99, 4.0, 11
#: Unrelated vectors of a cell, vectors of a block, cells of a task.
CELL, BLOCK, PACKED = 64, 512, 32

CODES = "node bigint, copies bigint, length int, unit binary, bands array<int>"
LINKED = "node bigint, links bigint, root bigint"


def rotation(length: int, turn: int) -> np.ndarray:
    """A random orthonormal matrix that depends on the length and the turn alone."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, length, turn]).standard_normal((length, length)))
    return q * np.sign(np.diag(r))


def shape(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(1, count) / CELL))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def band_values(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """For each vector and band, the band's bits of its codes as a number."""
    length = units.shape[1]
    turns = math.ceil(bits * bands / length)
    signs = np.concatenate([units @ rotation(length, t).T > 0 for t in range(turns)], 1)[:, : bits * bands]
    return (signs.reshape(len(units), bands, bits) << np.arange(bits)).sum(2).astype(np.int32)


def _coded(bits: int, bands: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for length, rows in batch.groupby("length"):
            units = np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), length)
            units /= np.abs(units).max(1, keepdims=True)  # no square leaves the range
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            values = band_values(units, bits, bands)
            yield rows[["node", "copies", "length"]].assign(unit=[u.tobytes() for u in units], bands=list(values))


def _pairs(units: np.ndarray, bands: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs between two lists of rows that meet in this band first."""
    length = units.shape[1]
    turned = units @ rotation(length, 0).T
    corners = np.where(turned > 0, 1.0, -1.0) / math.sqrt(length)
    factor = np.maximum((corners * turned).sum(1), 1e-9)
    bound = WIDTH * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, length - 1))
    estimate = (corners[left] @ turned[right].T) / factor[left, None]
    a, b = np.nonzero(estimate + bound[left, None] >= threshold)
    a, b = left[a], right[b]
    once = a < b if left is right else a != b
    a, b = a[once], b[once]
    for begin in range(0, len(a), 100_000):
        own = slice(begin, begin + 100_000)
        x, y = a[own], b[own]
        near = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
        x, y = x[near], y[near]
        first = ~(bands[x, :band] == bands[y, :band]).any(1) if band else np.ones(len(x), bool)
        yield x[first], y[first]


def _task(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One packed cell group or pair of blocks: links of each node, and a forest that joins them."""
    rows = rows.sort_values(["value", "node"], kind="stable")
    nodes, copies = rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
    sides, values = rows["side"].to_numpy(), rows["value"].to_numpy()
    units = np.array([np.frombuffer(u, np.float64) for u in rows["unit"]])
    bands = np.array(rows["bands"].tolist(), np.int32)
    band, across = int(rows["band"].iloc[0]), rows["i"].iloc[0] != rows["j"].iloc[0]
    links = np.zeros(len(nodes), np.int64)
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    for begin, end in zip(edges[:-1], edges[1:]):
        own = slice(begin, end)
        members = np.arange(end - begin)
        left, right = (members[sides[own] == 0], members[sides[own] == 1]) if across else (members, members)
        if end - begin < 2:
            continue
        for x, y in _pairs(units[own], bands[own], band, left, right, threshold):
            x, y = x + begin, y + begin
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            same = root[x] == root[y]
            for p, q in zip(x[~same].tolist(), y[~same].tolist()):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
    at = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[at], "links": links[at], "root": nodes[[find(i) for i in at.tolist()]]})


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept: a row for each row of ``embeddings``.

    Equal vectors are one node with a number of copies and link with one another.  Vectors
    of different lengths are not compared.  Null vectors, those without any component other
    than nought, and those with null or non-finite components link with nothing and stand
    for themselves; so does a row without a vec_id, which is not kept.  Rows that repeat a
    vec_id each count.  An empty table gives no rows; other columns are not read.
    """
    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0))).alias("embedding"))
    key = F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256)
    valid = rows.filter(F.col("embedding").isNotNull()).withColumn("key", key)
    classes = materialised(valid.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    bits, bands = shape(classes.count(), threshold, recall)
    coded = materialised(
        classes.select("node", "copies", "embedding", F.size("embedding").alias("length")).mapInPandas(lambda b: _coded(bits, bands, b), CODES), "codes"
    )
    in_cells = coded.select("node", "copies", "length", "unit", "bands", F.posexplode("bands").alias("band", "value"))
    sizes = in_cells.groupBy("length", "band", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("members"))
    # Cells of one member are gone here; of the rest, a member of a split cell goes to every pair of blocks with its own.
    placed = in_cells.join(sizes.filter("members > 1"), ["length", "band", "value"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
        .withColumn("cell", F.when(F.col("blocks") > 1, F.col("value")).otherwise(F.floor(F.col("value") / PACKED).cast("int")))
        .withColumn("split", F.col("blocks") > 1)
    )
    linked = dealt.groupBy("length", "band", "split", "cell", "i", "j").applyInPandas(lambda rows: _task(rows, threshold), LINKED)
    linked = materialised(linked, "linked")
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "component")
    per_class = (
        classes.select("key", "node", "copies").join(sums, "node", "left").join(joined, "node", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    all_rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull(), key)).select("vec_id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return all_rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
