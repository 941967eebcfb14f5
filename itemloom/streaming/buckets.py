"""A stream's state as a table of hash buckets: a batch writes the buckets it touches, no others.

Layout: ``batch=<n>/bucket=<b>`` holds a bucket as batch n left it, ``commits/batch=<n>`` names the
batch that wrote each bucket last.  The commit is written after the data, so a batch that is run
again starts from the commit before it and leaves the same one.  Folders that the newest two
commits do not name are removed.  The number of buckets is fixed for the life of a table; a
task rewrites a bucket, so choose it by the size of the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 64
KEPT = 2
COMMIT = "bucket INT, version BIGINT, batch BIGINT"


def _commits(spark: SparkSession, path: str) -> dict[int, dict[int, int]]:
    """Bucket -> version of each commit that still stands: KEPT + 1 at most."""
    try:
        rows = spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r["batch"], {})[r["bucket"]] = r["version"]
    return found


def _read(spark: SparkSession, path: str, schema, held: dict[int, int]) -> DataFrame:
    folders = [f"{path}/batch={version}/bucket={bucket}" for bucket, version in sorted(held.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of the newest commit; empty before the first."""
    path = path.rstrip("/")
    commits = _commits(spark, path)
    return _read(spark, path, schema, commits[max(commits)] if commits else {})


def merge(
    fresh: DataFrame,
    batch: int,
    path: str,
    schema,
    keys: Sequence[str],
    fold: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
    first: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Fold a batch's rows into the stored ones; ``fold`` maps rows of ``schema`` to a key's new ones.

    ``first`` combines the batch's rows on their own, where that is not ``fold`` too.
    Only the buckets of the batch's keys are read and written.  A batch without rows
    commits the buckets as they are.
    """
    spark, path = fresh.sparkSession, path.rstrip("/")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    # Written once: a batch of a stateful stream is not computed a second time.
    given = f"{path}/fresh/batch={batch}"
    (first or fold)(fresh).withColumn("bucket", bucket).write.mode("overwrite").parquet(given)
    rows = spark.read.parquet(given)
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    earlier = {n: held for n, held in _commits(spark, path).items() if n < batch}
    held = earlier[max(earlier)] if earlier else {}
    written = []
    if touched:
        stored = _read(spark, path, schema, {b: held[b] for b in touched if b in held})
        merged = fold(stored.unionByName(rows.drop("bucket"))).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")
        # A bucket that is left without rows has no folder.
        written = [r["bucket"] for r in spark.read.schema("bucket INT").parquet(f"{path}/batch={batch}").distinct().collect()]
    now = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(written, batch)
    commit = spark.createDataFrame(list(now.items()), "bucket INT, version BIGINT")
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    _prune(spark, path, {**earlier, batch: now})
    _remove(spark, given)


def _prune(spark: SparkSession, path: str, commits: dict[int, dict[int, int]]) -> None:
    kept = sorted(commits)[-KEPT:]
    named = {pair for n in kept for pair in commits[n].items()}
    versions = {version for _, version in named}
    for n in sorted(set(commits) - set(kept)):
        for bucket, version in set(commits[n].items()) - named:
            _remove(spark, f"{path}/batch={version}" + (f"/bucket={bucket}" if version in versions else ""))
        _remove(spark, f"{path}/commits/batch={n}")
