"""Question shards: discovery, scan, index and fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom import schemas

SHARD_GLOB = "{questions.jsonl,questions/*.jsonl}"
#: Hex digits of a path's hash that name its bucket of the fingerprint; part of the format.
FINGERPRINT_DIGITS = 3
#: Digests that are hashed to one; part of the format of row_digests.
FANOUT = 1000


def _relative(path: Column, kb: str) -> Column:
    """The part of a file's path below the root, in plain letters.

    The last occurrence of the root's own path is cut, as text: what stands before it is
    the store's scheme and authority.
    """
    root = "/" + kb.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, root, -1)


def discover_shards(spark: SparkSession, kb: str, glob: str = SHARD_GLOB) -> DataFrame:
    """Shard files on disk: ``questions.jsonl`` first, then ``questions/*.jsonl`` by name.

    File listing only; the content column is pruned, so no bytes are read.
    """
    files = spark.read.format("binaryFile").load(f"{kb}/{glob}")
    rel = _relative(F.col("_metadata.file_path"), kb)
    return files.select(rel.alias("path"), F.col("length"), (rel != "questions.jsonl").cast("int").alias("rank"))


def scan_questions(spark: SparkSession, kb: str, provider: str | None = None, glob: str = SHARD_GLOB) -> DataFrame:
    """One explicit-schema scan over every shard, with a corpus order key."""
    raw = (
        spark.read.schema(schemas.QUESTION).option("mode", "FAILFAST").json(f"{kb}/{glob}")
    )
    path = _relative(F.col("_metadata.file_path"), kb)
    rows = raw.select(
        "*",
        path.alias("shard_path"),
        F.struct(
            (path != "questions.jsonl").alias("later"),
            path.alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("order_key"),
    )
    return rows if provider is None else rows.where(F.col("source.provider") == provider)


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return (
        spark.read.format("binaryFile")
        .load(pattern)
        .select(F.col("_metadata.file_path").alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    )


def row_digests(rows: DataFrame, path: Column) -> DataFrame:
    """(path, sha256) of Parquet files by content: the digests of a file's rows, hashed in their order.

    FANOUT neighbours are hashed to one digest, twice, and what is left of a file then to
    one; a task holds a row or FANOUT digests, not a file, up to FANOUT ** 3 rows a file.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    at = F.col("_metadata.row_index")
    digests = rows.select(path.alias("path"), at.alias("at"), F.sha2(whole, 256).alias("sha256"))
    for _ in range(2):
        digests = _folded(digests, F.floor(F.col("at") / F.lit(FANOUT)))
    return _folded(digests, F.lit(0)).select("path", "sha256")


def _folded(digests: DataFrame, block: Column) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda r: r["sha256"])
    return digests.groupBy("path", block.alias("block")).agg(F.sha2(F.array_join(ordered, ""), 256).alias("sha256")).withColumnRenamed("block", "at")


def index_rows(records: DataFrame, path: str = "shard_path", provider: Column | None = None) -> DataFrame:
    """Per shard: line count and its provider, ``mixed`` when there are several."""
    who = F.col("source.provider") if provider is None else provider
    per = records.groupBy(F.col(path).alias("path")).agg(
        F.count(F.lit(1)).alias("line_count"), F.min(who).alias("lo"), F.max(who).alias("hi")
    )
    return per.select(
        "path",
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("mixed")).alias("provider"),
        "line_count",
    )


def mixed_shards(index: DataFrame) -> DataFrame:
    """Shards a strict index build refuses."""
    return index.where(F.col("provider") == "mixed")


def build_index(spark: SparkSession, kb: str) -> DataFrame:
    rows = index_rows(scan_questions(spark, kb))
    digests = file_digests(spark, f"{kb}/{SHARD_GLOB}").select(
        _relative(F.col("path"), kb).alias("path"), "sha256"
    )
    return digests.join(rows, "path", "left").select(
        "path",
        F.coalesce("provider", F.lit("unknown")).alias("provider"),
        F.coalesce("line_count", F.lit(0).cast("bigint")).alias("line_count"),
        "sha256",
    )


def index_staleness(found: DataFrame, index: DataFrame) -> DataFrame:
    """Files the index does not list, and listed files that are gone."""
    unlisted = found.select("path").join(index.select("path"), "path", "left_anti")
    absent = index.select("path").join(found.select("path"), "path", "left_anti")
    return unlisted.withColumn("problem", F.lit("unlisted")).unionByName(
        absent.withColumn("problem", F.lit("absent"))
    )


def index_changes(current: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Index entries that differ from a fresh build; empty means fresh."""
    fields = [c for c in current.columns if c != "path"]
    a = current.select("path", F.struct(*fields).alias("was"))
    b = recomputed.select("path", F.struct(*fields).alias("now"))
    return (
        a.join(b, "path", "full_outer")
        .where(~F.col("was").eqNullSafe(F.col("now")))
        .select(
            "path",
            F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"),
        )
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """One-row sha256 identity of (kind, path, sha256) rows, by one definition at every size.

    A file's bucket is the first FINGERPRINT_DIGITS hex digits of its path's md5.  A bucket's
    digest is that of its ``path:sha256`` lines in (kind, path) order, the root's that of the
    ``bucket:digest`` lines of all buckets that hold a file.
    """
    line = F.concat(F.col("path"), F.lit(":"), F.col("sha256"), F.lit("\n"))

    def digest(rows: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda r: r["line"]), ""), 256)

    buckets = (
        files.select(F.left(F.md5("path"), F.lit(FINGERPRINT_DIGITS)).alias("bucket"), F.struct("kind", "path", line.alias("line")).alias("r"))
        .groupBy("bucket")
        .agg(digest(F.collect_list("r")).alias("d"))
    )
    lines = F.collect_list(F.struct("bucket", F.concat("bucket", F.lit(":"), "d", F.lit("\n")).alias("line")))
    return buckets.agg(digest(lines).alias("fingerprint"))


def scan_blueprints(spark: SparkSession, kb: str) -> DataFrame:
    return (
        spark.read.schema(schemas.BLUEPRINT)
        .option("recursiveFileLookup", True)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(f"{kb}/blueprints")
        .withColumn("path", F.col("_metadata.file_path"))
    )
