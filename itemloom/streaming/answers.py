"""The answer log as a stream: item state and refused events, kept current by DataFrame operations.

Per (attempt, position) the state is the fold of all answers older than the watermark, one row,
and a row for each newer answer, which may still get neighbours in between.  What a batch
leaves is the fold of both, so the table is right after each batch and not only behind the
watermark.  Nothing is dropped: an answer older than what is folded for good becomes a
refused row (``late``), and so does one whose id still waits (``repeated``).  Shows commute
and repeat without effect, so they are never late.  The watermark is that of the events of the
batches before, as Spark's own is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from itemloom.operators.state import judge_answers
from itemloom.streaming import buckets

KEYS = ["attempt_id", "position"]
GIVEN = "attempt_id BIGINT, position INT, us BIGINT, id BIGINT, kind STRING, selection STRING, time_ms BIGINT, reason STRING"
#: ``what``: base (a key's fold up to ``bound``; ``now`` has the waiting answers too), wait, refused (of ``batch``),
#: and of the batch that is being merged: new (an answer), show, touch (an event refused before).
ITEM_STATE = (
    "attempt_id BIGINT, position INT, what STRING, us BIGINT, id BIGINT, selection STRING, time_ms BIGINT, bound BIGINT, answered BIGINT, "
    "shown BIGINT, changes BIGINT, now STRUCT<selection: STRING, answered: BIGINT, time_ms: BIGINT, changes: BIGINT>, reason STRING, batch BIGINT"
)
REFUSED = "attempt_id BIGINT, position INT, us BIGINT, id BIGINT, kind STRING, selection STRING, time_ms BIGINT, reason STRING"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _rows(given: DataFrame) -> DataFrame:
    """A batch's events as rows of the state."""
    what = F.when(F.col("reason").isNotNull(), "touch").when(F.col("kind") == "answer", "new").otherwise("show")
    answer = what == "new"
    own = lambda c: F.when(answer, F.col(c)).alias(c)
    rows = given.select(*KEYS, what.alias("what"), F.when(what != "touch", F.col("us")).alias("us"), own("id"), own("selection"), own("time_ms"))
    return given.sparkSession.createDataFrame([], ITEM_STATE).unionByName(rows, allowMissingColumns=True)


def _flagged(rows: DataFrame, horizon: int) -> DataFrame:
    """State and batch rows with the reason to refuse an answer, and ``bound`` as the batch leaves it."""
    of_key, what = Window.partitionBy(*KEYS), F.col("what")
    touched = F.max(what.isin("new", "show", "touch")).over(of_key)
    known = rows.where(what != "refused").withColumn("before", F.max("bound").over(of_key)).withColumn("touched", touched)
    late = (what == "new") & F.coalesce(F.col("us") < F.col("before"), F.lit(False))
    known = known.withColumn("late", late).withColumn("open", what.isin("wait", "new") & ~late)
    nth = F.row_number().over(Window.partitionBy(*KEYS, "open", "id").orderBy(what == "new", "us", "selection", "time_ms"))
    known = known.withColumn("nth", nth)
    reason = F.when(F.col("late"), "late").when(F.col("open") & (what == "new") & (F.col("nth") > 1), "repeated")
    moved = F.when(F.col("touched") & F.lit(horizon > 0), F.greatest(F.coalesce("before", F.lit(0)), F.lit(horizon))).otherwise(F.col("before"))
    return known.withColumn("reason", reason).withColumn("bound", moved.cast("bigint")).select(*[f.name for f in rows.schema])


def _bases(kept: DataFrame) -> DataFrame:
    """A base row a key: its answers in order behind what is folded; shows and touches stand apart."""
    what = F.col("what")
    answer = what.isin("wait", "new")
    order = Window.partitionBy(*KEYS, "aside").orderBy(F.col("us").asc_nulls_first(), "id")
    rows = kept.withColumn("aside", what.isin("show", "touch")).withColumn("prev", F.lag("selection").over(order))
    base = what == "base"
    rows = rows.select(
        *KEYS, "what", "bound", "selection", "aside", F.struct("us", "id").alias("place"),
        F.when(base, F.col("answered")).when(answer, F.col("us")).alias("answered"),
        F.when(base, F.col("shown")).otherwise(F.col("us")).alias("shown"),
        F.when(base, F.col("time_ms")).when(answer, F.greatest(F.lit(0), F.coalesce("time_ms", F.lit(0)))).otherwise(0).cast("bigint").alias("time_ms"),
        F.when(base, F.col("changes")).otherwise((answer & F.coalesce(F.col("prev") != F.col("selection"), F.lit(False))).cast("bigint")).alias("changes"),
        (base | (answer & F.coalesce(F.col("us") < F.col("bound"), F.lit(False)))).alias("settled"),
    )

    def fold(which) -> list:
        of = lambda c: F.when(which, F.col(c))
        return [
            F.max_by("selection", F.when(which, F.col("place"))).alias("selection"),
            F.max(of("answered")).alias("answered"),
            F.coalesce(F.sum(of("time_ms")), F.lit(0)).alias("time_ms"),
            F.coalesce(F.sum(of("changes")), F.lit(0)).alias("changes"),
        ]

    done = rows.groupBy(*KEYS).agg(
        *fold(F.col("settled")), F.struct(*fold(~F.col("aside"))).alias("now"), F.max("bound").alias("bound"), F.min("shown").alias("shown"),
        F.max(F.col("what") != "touch").alias("seen"),
    )
    return done.where("seen").drop("seen").withColumn("what", F.lit("base"))


def _folded(rows: DataFrame, batch: int, horizon: int, folder: str) -> DataFrame:
    """The state as a batch leaves it, and the rows the batch refuses."""
    spark = rows.sparkSession
    _flagged(rows, horizon).write.mode("overwrite").parquet(folder)  # read three times below, computed once
    flagged = spark.read.schema(ITEM_STATE).parquet(folder)
    kept = flagged.where(F.col("reason").isNull())
    waits = kept.where(F.col("what").isin("wait", "new") & (F.col("bound").isNull() | (F.col("us") >= F.col("bound"))))
    state = spark.createDataFrame([], ITEM_STATE).unionByName(_bases(kept), allowMissingColumns=True)
    state = state.unionByName(waits.withColumn("what", F.lit("wait")).withColumn("bound", F.lit(None).cast("bigint")))
    refused = flagged.where(F.col("reason").isNotNull())
    return state.unionByName(refused.withColumn("what", F.lit("refused")).withColumn("batch", F.lit(batch).cast("bigint")))


def _newest(given: DataFrame, batch: int, path: str, delay: str) -> int:
    """The watermark in microseconds as of the batches before, 0 where there are none; this batch's newest event is noted."""
    spark = given.sparkSession
    try:
        before = spark.read.schema("newest BIGINT, batch BIGINT").parquet(f"{path}/newest").where(F.col("batch") < batch).agg(F.max("newest")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        before = None
    newest = given.agg(F.greatest(F.max("us"), F.lit(before).cast("bigint")).alias("newest"))
    newest.write.mode("overwrite").parquet(f"{path}/newest/batch={batch}")
    buckets._remove(spark, f"{path}/newest/batch={batch - 3}")
    if before is None:
        return 0
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    wait = spark.range(1).select(F.timestamp_diff("MICROSECOND", start, start + F.expr(f"INTERVAL '{delay}'"))).first()[0]
    return max(0, (before // 1000 - wait // 1000) * 1000)


def maintain_answer_log(
    events: DataFrame, attempt: DataFrame, path: str, checkpoint: str, delay: str = "7 days", trigger: dict | None = None
) -> StreamingQuery:
    """Keep item state and refused events of a stream of answer events below ``path``.

    Events: attempt_id, position, at, id, kind (show | answer), selection, time_ms; attempts: id,
    closed_at.  Answers may come up to ``delay`` behind the newest event and in any order.
    Events without a time or an id are refused.
    """
    judged = judge_answers(events, attempt)
    reason = F.when(F.col("at").isNull(), "no time").when(F.col("id").isNull(), "no id").otherwise(F.col("reason"))
    rows = judged.select(
        F.col("attempt_id").cast("bigint").alias("attempt_id"), F.col("position").cast("int").alias("position"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("id").cast("bigint").alias("id"), "kind", "selection",
        F.col("time_ms").cast("bigint").alias("time_ms"), reason.alias("reason"),
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, whole, flagged = batch.sparkSession, f"{path}/given/batch={batch_id}", f"{path}/flagged/batch={batch_id}"
        batch.write.mode("overwrite").parquet(whole)  # read several times below, computed once
        given = spark.read.schema(GIVEN).parquet(whole)
        horizon = _newest(given, batch_id, path, delay)
        fold = lambda rows: _folded(rows, batch_id, horizon, flagged)
        buckets.merge(_rows(given), batch_id, f"{path}/items", ITEM_STATE, KEYS, fold, first=lambda rows: rows)
        here = buckets.read(spark, f"{path}/items", ITEM_STATE).where((F.col("what") == "refused") & (F.col("batch") == batch_id))
        refused = given.where(F.col("reason").isNotNull()).select(*_names(REFUSED))
        refused = refused.unionByName(here.withColumn("kind", F.lit("answer")).select(*_names(REFUSED)))
        refused.write.mode("overwrite").parquet(f"{path}/refused/batch={batch_id}")
        for folder in (whole, flagged):
            buckets._remove(spark, folder)

    return (
        rows.writeStream.foreachBatch(merge)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _ntz(us: str):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def item_state(spark: SparkSession, path: str) -> DataFrame:
    """Item state as ``state.fold_answers`` gives it, as of the newest committed batch."""
    rows = buckets.read(spark, f"{path}/items", ITEM_STATE).where(F.col("what") == "base")
    return rows.select(
        *KEYS, "now.selection", _ntz("now.answered").alias("answered_at"), _ntz("shown").alias("first_shown_at"), "now.time_ms", F.col("now.changes").alias("change_count")
    )


def refused_events(spark: SparkSession, path: str) -> DataFrame:
    """Every refused event with its reason: unknown attempt | closed | no time | no id | late | repeated."""
    rows = spark.read.schema(REFUSED).parquet(f"{path}/refused")
    return rows.select(*KEYS, _ntz("us").alias("at"), "id", "kind", "selection", "time_ms", "reason")
