"""Marks import blobs: four JSON shapes to (question_id, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WRAPPERS = ("marks", "kb-marks", "kbMarks")
_MAP = "map<string,string>"
_LIST = "array<struct<question_id:string,id:string,value:string>>"


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their modification time as the mark time."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("at")
    )


def _list_entries(body: Column) -> Column:
    return F.transform(
        F.from_json(body, _LIST),
        lambda e: F.struct(
            F.coalesce(F.nullif(e["question_id"], F.lit("")), e["id"]).alias("question_id"),
            F.coalesce(e["value"], F.lit("")).alias("value"),
        ),
    )


def _map_entries(body: Column) -> Column:
    return F.transform(
        F.map_entries(F.from_json(body, _MAP)),
        lambda e: F.struct(e["key"].alias("question_id"), F.coalesce(e["value"], F.lit("")).alias("value")),
    )


def parse_blobs(blobs: DataFrame, raw: str = "raw") -> DataFrame:
    """Explode every blob; wrappers are opened once, JSON inside a string too."""
    inner = F.coalesce(*[F.get_json_object(F.col(raw), f"$['{k}']") for k in WRAPPERS])
    opened = F.when(F.ltrim(inner).rlike(r"^[\[{]"), inner)
    body = F.coalesce(opened, F.col(raw))
    is_list = F.ltrim(body).startswith("[")
    entries = F.when(is_list, _list_entries(body)).otherwise(_map_entries(body))
    keep = [c for c in blobs.columns if c != raw]
    return blobs.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*").where(
        F.coalesce("question_id", F.lit("")) != ""
    )
