"""Journals as streams: the batch folds, kept current.

The fold is associative per key (latest by (time, id)), so each micro-batch is combined
on its own first and then merged with the stored state, a table of hash buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itemloom.streaming import buckets

MARK_STATE = "question_id BIGINT, value STRING, created_at TIMESTAMP_NTZ, id BIGINT"


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_marks(mark: DataFrame) -> DataFrame:
    """Combinable form of the current mark: the whole latest row per question."""
    return (
        mark.groupBy("question_id")
        .agg(F.max(F.struct("created_at", "id", "value")).alias("m"))
        .select("question_id", "m.value", "m.created_at", "m.id")
    )


def maintain_current_marks(
    marks: DataFrame, state_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the current-mark table up to date; start with ``availableNow`` to catch up and stop."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        buckets.merge(batch, batch_id, state_path, MARK_STATE, ["question_id"], latest_marks)

    return (
        marks.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The table as of the newest committed batch, whichever run wrote it; empty before the first."""
    return buckets.read(spark, state_path, MARK_STATE)
