"""Current state derived from append-only journals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import blocked

MARK_VALUES = ("known", "unsure", "flagged")
CLEARED = "cleared"


def _day(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


# ------------------------------------------------------------------ marks


def current_mark(mark: DataFrame) -> DataFrame:
    """Latest mark per question by (created_at, id): a partial-combining aggregate."""
    return mark.groupBy("question_id").agg(
        F.max_by("value", F.struct("created_at", "id")).alias("value"),
        F.max("created_at").alias("marked_at"),
    )


def mark_counts(current: DataFrame, values: Sequence[str] = MARK_VALUES) -> DataFrame:
    """Zero-filled count per vocabulary value; cleared marks drop out."""
    spark = current.sparkSession
    vocabulary = spark.createDataFrame([(v,) for v in values], "value string")
    found = current.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(found, "value", "left").select(
        "value", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def mark_history(mark: DataFrame) -> DataFrame:
    """Every mark with its 1-based place in its question's history."""
    return blocked.row_number(
        mark, ["question_id"], _day("created_at"), [F.col("created_at"), F.col("id")], "seq"
    )


def append_marks(mark: DataFrame, new: DataFrame, values: Sequence[str] = (*MARK_VALUES, CLEARED)):
    """(journal with the valid new rows appended, the rows refused)."""
    valid = F.coalesce(F.col("value").isin(*values), F.lit(False))
    return mark.unionByName(new.where(valid)), new.where(~valid)


def fold_toggles(events: DataFrame) -> DataFrame:
    """State after each toggle: within a run of equal toggles, odd sets and even clears.

    Columns: question_id, value, created_at, id.  Adds ``state`` (NULL = cleared).  Days
    cut a long log into blocks; each block hands on its last value and the length of its
    trailing run, so a run may span any number of blocks.
    """
    keys = ["question_id", "__day"]
    inside = Window.partitionBy(*keys).orderBy("created_at", "id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy("created_at", "id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    before = F.lag("value").over(inside)
    placed = (
        events.withColumn("__day", _day("created_at"))
        .withColumn("__rn", F.row_number().over(inside))
        .withColumn("__turn", F.when(before.isNull() | (before != F.col("value")), F.col("__rn")))
        .withColumn("__start", F.last("__turn", ignorenulls=True).over(upto))
        .withColumn("__head", F.first("value").over(whole))
        .withColumn("__n", F.count(F.lit(1)).over(whole))
    )
    tails = placed.where(F.col("__rn") == F.col("__n")).select(
        *keys,
        "__head",
        F.col("value").alias("__tail"),
        F.col("__n"),
        (F.col("__n") - F.col("__start") + 1).alias("__trail"),
        (F.col("__start") == 1).alias("__uniform"),
    )
    days = Window.partitionBy("question_id").orderBy("__day")
    handed = (
        tails.withColumn("__prior", F.lag("__tail").over(days))
        .withColumn("__fresh", ~(F.col("__uniform") & F.coalesce(F.col("__prior") == F.col("__head"), F.lit(False))))
        .withColumn("__group", F.sum(F.col("__fresh").cast("int")).over(days))
        .withColumn(
            "__length",
            F.sum(F.when(F.col("__fresh"), F.col("__trail")).otherwise(F.col("__n"))).over(
                Window.partitionBy("question_id", "__group").orderBy("__day")
            ),
        )
        .select(*keys, F.col("__prior"), F.lag("__length").over(days).alias("__carried"))
    )
    joined = placed.join(handed, keys, "left")
    continues = (F.col("__start") == 1) & F.coalesce(F.col("__prior") == F.col("value"), F.lit(False))
    place = F.col("__rn") - F.col("__start") + 1 + F.when(continues, F.col("__carried")).otherwise(0)
    return joined.select(*events.columns, F.when(place % 2 == 1, F.col("value")).alias("state"))


def classify_import(
    incoming: DataFrame,
    question: DataFrame,
    current: DataFrame,
    values: Sequence[str] = MARK_VALUES,
    cleared: str = CLEARED,
) -> DataFrame:
    """Incoming (question_id, value) rows with their fate; running it twice imports nothing."""
    live = current.select("question_id", F.nullif("value", F.lit(cleared)).alias("__now"))
    known = question.select(F.col("id").alias("question_id"), F.lit(True).alias("__known"))
    return (
        incoming.join(known, "question_id", "left")
        .join(live, "question_id", "left")
        .withColumn(
            "fate",
            F.when(F.coalesce("value", F.lit("")) == "", "empty")
            .when(~F.col("value").isin(*values), "ignored")
            .when(F.col("__known").isNull(), "unmatched")
            .when(F.col("__now") == F.col("value"), "skipped")
            .otherwise("imported"),
        )
        .drop("__known", "__now")
    )


# ----------------------------------------------------- verification and keys


def question_verification(question: DataFrame, event: DataFrame, dispute: DataFrame) -> DataFrame:
    """known_bad > disputed (open) > human_reviewed > ai_reviewed > unverified."""
    levels = event.groupBy("question_id").agg(
        *[F.max((F.col("level") == lv).cast("int")).alias(lv) for lv in ("known_bad", "human_reviewed", "ai_reviewed")]
    )
    open_disputes = dispute.where(F.col("state") == "open").select("question_id").distinct()
    joined = (
        question.select(F.col("id").alias("question_id"))
        .join(levels, "question_id", "left")
        .join(open_disputes.withColumn("disputed", F.lit(1)), "question_id", "left")
    )
    return joined.select(
        "question_id",
        F.when(F.col("known_bad") == 1, "known_bad")
        .when(F.col("disputed") == 1, "disputed")
        .when(F.col("human_reviewed") == 1, "human_reviewed")
        .when(F.col("ai_reviewed") == 1, "ai_reviewed")
        .otherwise("unverified")
        .alias("verification"),
    )


def current_answer_key(question: DataFrame, override: DataFrame) -> DataFrame:
    """Latest unretired override by (effective_from, id), else the stored key."""
    in_force = (
        override.where(F.col("retired_at").isNull())
        .groupBy("question_id")
        .agg(F.max_by(F.struct("correct_labels", "id"), F.struct("effective_from", "id")).alias("__o"))
    )
    return (
        question.select(F.col("id").alias("question_id"), F.col("correct_labels").alias("__stored"))
        .join(in_force, "question_id", "left")
        .select(
            "question_id",
            F.coalesce("__o.correct_labels", "__stored").alias("correct_labels"),
            F.col("__o.id").alias("override_id"),
            F.when(F.col("__o.id").isNull(), 0).otherwise(1).alias("is_override"),
        )
    )


# ------------------------------------------------------------------ attempts


def is_open() -> Column:
    return F.col("submitted_at").isNull() & F.col("abandoned_at").isNull()


def is_finished() -> Column:
    return F.col("submitted_at").isNotNull() & F.col("abandoned_at").isNull()


def attempt_score(attempt: DataFrame, item: DataFrame) -> DataFrame:
    """Counts and credit per attempt, attempts without items included."""
    totals = item.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count("answered_at").alias("answered_count"),
        F.count_if("is_correct").alias("correct_count"),
        F.sum(F.coalesce("credit", F.lit(0.0))).alias("credit_total"),
    )
    zero = F.lit(0).cast("bigint")
    return attempt.join(totals, attempt["id"] == totals["attempt_id"], "left").select(
        attempt["id"].alias("attempt_id"),
        "certification_id",
        "started_at",
        "submitted_at",
        F.coalesce("item_count", zero).alias("item_count"),
        F.coalesce("answered_count", zero).alias("answered_count"),
        F.coalesce("correct_count", zero).alias("correct_count"),
        F.coalesce("credit_total", F.lit(0.0)).alias("credit_total"),
    )


def first_exposure_response(attempt: DataFrame, item: DataFrame) -> DataFrame:
    """Earliest answered item per question over submitted, unabandoned attempts."""
    finished = attempt.where(is_finished()).select(F.col("id").alias("attempt_id"))
    kept = item.where(F.col("answered_at").isNotNull()).join(finished, "attempt_id", "left_semi")
    return (
        kept.groupBy("question_id")
        .agg(
            F.min_by(
                F.struct("id", "attempt_id", "is_correct", "credit", "answered_at"),
                F.struct("answered_at", "id"),
            ).alias("f")
        )
        .select("question_id", F.col("f.id").alias("attempt_item_id"), "f.attempt_id", "f.is_correct", "f.credit", "f.answered_at")
    )


def seen_ordinal(attempt: DataFrame, item: DataFrame) -> DataFrame:
    """1 + earlier exposures of the question, by attempt start."""
    started = attempt.select(F.col("id").alias("attempt_id"), "started_at")
    return blocked.row_number(
        item.join(started, "attempt_id"),
        ["question_id"],
        F.date_trunc("month", F.col("started_at")),
        [F.col("started_at"), F.col("attempt_id"), F.col("id")],
        "seen_ordinal",
    )


def prior_exposures(item: DataFrame) -> DataFrame:
    """Exposures per question, abandoned attempts included."""
    return item.groupBy("question_id").agg(F.count(F.lit(1)).alias("exposures"))


def last_seen(item: DataFrame) -> DataFrame:
    """Latest time each question was shown."""
    return (
        item.where(F.col("first_shown_at").isNotNull())
        .groupBy("question_id")
        .agg(F.max("first_shown_at").alias("last_seen_at"))
    )


def attempt_progress(attempt: DataFrame, item: DataFrame) -> DataFrame:
    """Answered, unanswered, completeness and the first unanswered position (0 if none)."""
    done = F.col("answered_at").isNotNull()
    per = item.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(done).alias("answered"),
        F.min(F.when(~done, F.col("position"))).alias("next_position"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        attempt.select(F.col("id").alias("attempt_id"))
        .join(per, "attempt_id", "left")
        .select(
            "attempt_id",
            F.coalesce("items", zero).alias("items"),
            F.coalesce("answered", zero).alias("answered"),
            (F.coalesce("items", zero) - F.coalesce("answered", zero)).alias("unanswered"),
            (F.coalesce("items", zero) == F.coalesce("answered", zero)).alias("complete"),
            F.coalesce("next_position", F.lit(0)).alias("first_unanswered"),
        )
    )


def open_attempt(attempt: DataFrame) -> DataFrame:
    """The latest open attempt per certification."""
    return (
        attempt.where(is_open())
        .groupBy("certification_id")
        .agg(F.max_by(F.struct("id", "started_at"), F.struct("started_at", "id")).alias("a"))
        .select("certification_id", F.col("a.id").alias("attempt_id"), "a.started_at")
    )


def recent_finished(attempt: DataFrame, limit: int = 20) -> DataFrame:
    return (
        attempt.where(F.col("submitted_at").isNotNull())
        .orderBy(F.col("submitted_at").desc(), F.col("id").desc())
        .limit(limit)
    )


def questions_in_open_attempts(attempt: DataFrame, item: DataFrame) -> DataFrame:
    """Distinct question ids an open attempt still contains."""
    still_open = attempt.where(is_open()).select(F.col("id").alias("attempt_id"))
    return item.join(still_open, "attempt_id", "left_semi").select("question_id").distinct()


def lifecycle(attempt: DataFrame, closings: DataFrame) -> DataFrame:
    """Close attempts from (attempt_id, action, at) events; only the first closing counts.

    Adds state, closing times, elapsed_ms and the number of refused further closings.
    """
    first = closings.groupBy("attempt_id").agg(
        F.min_by(F.struct("action", "at"), F.struct("at", "action")).alias("c"),
        (F.count(F.lit(1)) - F.lit(1)).alias("refused"),
    )
    joined = attempt.select(F.col("id").alias("attempt_id"), "started_at").join(first, "attempt_id", "left")
    at = F.col("c.at")
    return joined.select(
        "attempt_id",
        F.when(F.col("c.action") == "submit", "submitted")
        .when(F.col("c.action") == "abandon", "abandoned")
        .otherwise("open")
        .alias("state"),
        F.when(F.col("c.action") == "submit", at).alias("submitted_at"),
        F.when(F.col("c.action") == "abandon", at).alias("abandoned_at"),
        elapsed_ms(F.col("started_at"), at).alias("elapsed_ms"),
        F.coalesce("refused", F.lit(0).cast("bigint")).alias("refused"),
    )


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_ms(started: Column, ended: Column) -> Column:
    return F.floor((_micros(ended) - _micros(started)) / 1000).cast("bigint")


# --------------------------------------------------------------- answer log


def normalise_answer(offered: Column, chosen: Column) -> Column:
    """struct(kept in offered order, unknown labels)."""
    return F.struct(
        F.filter(offered, lambda label: F.array_contains(chosen, label)).alias("kept"),
        F.array_except(chosen, offered).alias("unknown"),
    )


def judge_answers(events: DataFrame, attempt: DataFrame) -> DataFrame:
    """All events with why they are refused; null where they are not."""
    closed = attempt.select(F.col("id").alias("__attempt"), F.col("closed_at").alias("__closed"))
    late = (F.col("kind") == "answer") & (F.col("at") > F.col("__closed"))
    reason = F.when(F.col("__attempt").isNull(), "unknown attempt").when(late, "closed")
    joined = events.join(closed, F.col("attempt_id") == F.col("__attempt"), "left")
    return joined.withColumn("reason", reason).drop("__attempt", "__closed")


def refused_answers(events: DataFrame, attempt: DataFrame) -> DataFrame:
    """The events that ``fold_answers`` leaves out, each with its reason: unknown attempt | closed."""
    return judge_answers(events, attempt).where(F.col("reason").isNotNull())


def fold_answers(events: DataFrame, attempt: DataFrame | None = None) -> DataFrame:
    """Answer log -> item state.

    Events: attempt_id, position, at, id, kind (show | answer), selection (string),
    time_ms.  With ``attempt`` (id, closed_at) answers after the close and events of
    unknown attempts are left to ``refused_answers``; items may be shown after the close.
    """
    if attempt is not None:
        events = judge_answers(events, attempt).where(F.col("reason").isNull()).drop("reason")
    keys, answer = ["attempt_id", "position"], F.col("kind") == "answer"
    order = [F.col("at"), F.col("id")]
    answers = blocked.lag(
        events.where(answer), keys, _day("at"), order, F.col("selection"), "__prev"
    )
    moved = F.col("__prev").isNotNull() & (F.col("__prev") != F.col("selection"))
    folded = answers.groupBy(*keys).agg(
        F.max_by("selection", F.struct(*order)).alias("selection"),
        F.max("at").alias("answered_at"),
        F.sum(F.greatest(F.lit(0).cast("bigint"), F.col("time_ms"))).alias("time_ms"),
        F.count_if(moved).alias("change_count"),
    )
    shown = events.groupBy(*keys).agg(F.min("at").alias("first_shown_at"))
    return shown.join(folded, keys, "left").select(
        *keys,
        "selection",
        "answered_at",
        "first_shown_at",
        F.coalesce("time_ms", F.lit(0).cast("bigint")).alias("time_ms"),
        F.coalesce("change_count", F.lit(0).cast("bigint")).alias("change_count"),
    )
