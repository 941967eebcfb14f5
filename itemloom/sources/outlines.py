"""Blueprint outline text files: lines, headers, bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as tx

BULLET = r"^( *)- (?:\[([^\]]+)\]\s*)?(.*)$"
HEADER = r"^([a-z_]+):[ ]?(.*)$"
INDENT = 2


def read_outlines(spark: SparkSession, path: str, suffix: str = "*.blueprint") -> DataFrame:
    """(file, line_no, raw) of every outline file below ``path``."""
    whole = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "raw"))
    return lines.select("file", (F.col("at") + 1).cast("bigint").alias("line_no"), "raw")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Drop blanks and comments; tag each line bullet, header or other, with its parts."""
    kept = lines.where((F.trim("raw") != "") & ~F.ltrim("raw").startswith("#"))
    bullet, header = F.col("raw").rlike(BULLET), F.col("raw").rlike(HEADER)

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract("raw", pattern, i)

    return kept.select(
        "file",
        "line_no",
        "raw",
        F.when(bullet, "bullet").when(header, "header").otherwise("other").alias("kind"),
        F.when(bullet, F.length(group(BULLET, 1))).alias("spaces"),
        F.when(bullet, F.nullif(group(BULLET, 2), F.lit(""))).alias("weight_text"),
        F.when(bullet, group(BULLET, 3)).alias("label"),
        F.when(~bullet & header, group(HEADER, 1)).alias("key"),
        F.when(~bullet & header, F.rtrim(group(HEADER, 2))).alias("value"),
    )


def headers(classified: DataFrame) -> DataFrame:
    """First value per (file, key); ``source`` repeats and is read by ``sources``."""
    return (
        classified.where((F.col("kind") == "header") & (F.col("key") != "source"))
        .groupBy("file", "key")
        .agg(F.min_by("value", "line_no").alias("value"))
    )


def sources(classified: DataFrame) -> DataFrame:
    rows = classified.where((F.col("kind") == "header") & (F.col("key") == "source"))
    return rows.select("file", "line_no", tx.source_fields(F.col("value")).alias("s")).select("file", "line_no", "s.*")
