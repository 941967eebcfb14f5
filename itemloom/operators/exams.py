"""Grading: item grades, attempt totals, domain results, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import grading as g


def grade_items(item: DataFrame) -> DataFrame:
    """Adds key, chosen, ways (penalty denominator), is_correct, outcome and credit.

    Needs option_labels, correct_labels, selected_labels and, optionally, select_count.
    """
    declared = F.col("select_count") if "select_count" in item.columns else F.lit(None).cast("int")
    keyed = item.withColumn("key", g.key_labels(F.col("option_labels"), F.col("correct_labels"))).withColumn(
        "chosen", g.chosen_labels(F.col("option_labels"), F.col("selected_labels"))
    )
    sized = keyed.withColumn("wanted", g.select_count(declared, F.col("key"))).withColumn(
        "ways", g.wrong_ways(F.size("option_labels"), F.col("wanted"))
    )
    key, chosen = F.col("key"), F.col("chosen")
    return (
        sized.withColumn("is_correct", g.is_correct(key, chosen))
        .withColumn("outcome", g.outcome(key, chosen, F.col("wanted")))
        .withColumn("credit", g.credit(key, chosen, F.col("ways")))
    )


def ungradable_items(item: DataFrame) -> DataFrame:
    """Items with no options or no correct answer to mark against."""
    key = g.key_labels(F.col("option_labels"), F.col("correct_labels"))
    return item.where((F.size("option_labels") == 0) | (F.size(key) == 0)).withColumn(
        "problem", F.when(F.size("option_labels") == 0, "no options").otherwise("no correct answer")
    )


def _with_scale(attempt: DataFrame, scale: DataFrame | None) -> DataFrame:
    if scale is None:
        return attempt.select(
            "*", F.lit(g.SCALE_MIN).alias("scale_min"), F.lit(g.SCALE_MAX).alias("scale_max"), F.lit(g.CUT_SCORE).alias("cut_score")
        )
    s = scale.select("certification_id", *[F.col(c).alias(f"__{c}") for c in ("scale_min", "scale_max", "cut_score")])
    return attempt.join(s, "certification_id", "left").select(
        *attempt.columns,
        F.coalesce("__scale_min", F.lit(g.SCALE_MIN)).alias("scale_min"),
        F.coalesce("__scale_max", F.lit(g.SCALE_MAX)).alias("scale_max"),
        F.coalesce("__cut_score", F.lit(g.CUT_SCORE)).alias("cut_score"),
    )


def attempt_totals(graded: DataFrame) -> DataFrame:
    """Per attempt: items, answered, correct, and credit.

    Penalties are counted per denominator first and divided once in decimal arithmetic,
    so thousands of thirds do not drift.
    """
    wrong = (F.size("chosen") > 0) & ~F.col("is_correct") & (F.col("ways") > 0)
    per = graded.groupBy("attempt_id", F.when(wrong, F.col("ways")).alias("ways")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("answered_at").alias("answered"),
        F.count_if("is_correct").alias("correct"),
    )
    share = F.when(F.col("ways").isNotNull(), F.col("n").cast("decimal(18,0)") / F.col("ways").cast("decimal(18,0)")).otherwise(
        F.lit(0).cast("decimal(18,0)")
    )
    return per.groupBy("attempt_id").agg(
        F.sum("n").alias("item_count"),
        F.sum("answered").alias("answered_count"),
        F.sum("correct").alias("correct_count"),
        (F.sum("correct") - F.sum(share)).cast("double").alias("credit_total"),
    )


def grade_attempts(
    attempt: DataFrame, item: DataFrame, scale: DataFrame | None = None, graded: DataFrame | None = None
) -> DataFrame:
    """Grade submitted attempts once; attempts in ``graded`` (attempt_id) are left alone."""
    todo = attempt.where(F.col("submitted_at").isNotNull())
    if graded is not None:
        todo = todo.join(graded.select(F.col("attempt_id").alias("id")), "id", "left_anti")
    todo = _with_scale(todo.select(F.col("id").alias("attempt_id"), "certification_id"), scale)
    zero = F.lit(0).cast("bigint")
    joined = todo.join(attempt_totals(grade_items(item)), "attempt_id", "left")
    proportion = F.coalesce(F.try_divide(F.col("correct_count"), F.col("item_count")), F.lit(0.0))
    score = g.scaled_score(proportion, F.col("scale_min"), F.col("scale_max"))
    return joined.select(
        "attempt_id",
        "certification_id",
        F.coalesce("item_count", zero).alias("item_count"),
        F.coalesce("answered_count", zero).alias("answered_count"),
        F.coalesce("correct_count", zero).alias("correct_count"),
        F.coalesce("credit_total", F.lit(0.0)).alias("credit_total"),
        score.alias("scaled_score"),
        (score >= F.col("cut_score")).alias("passed"),
    )


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def share_text(part: Column, whole: Column) -> Column:
    return F.concat(part.cast("string"), F.lit(" of "), whole.cast("string"))


def domain_results(item: DataFrame) -> DataFrame:
    """Per attempt and domain: asked, correct, percent; ``worst_rank`` orders worst first."""
    label = F.coalesce(F.nullif("domain_label", F.lit("")), F.lit("unspecified"))
    return (
        item.groupBy("attempt_id", label.alias("label"))
        .agg(F.count(F.lit(1)).alias("asked"), F.count_if("is_correct").alias("correct"))
        .select(
            "attempt_id",
            "label",
            "asked",
            "correct",
            percent(F.col("correct"), F.col("asked")).alias("percent"),
            share_text(F.col("correct"), F.col("asked")).alias("share"),
        )
        .withColumn("worst_rank", F.row_number().over(Window.partitionBy("attempt_id").orderBy("percent", "label")))
    )


SPAN = 65536


def guessing_space(keys: DataFrame) -> DataFrame:
    """Every response a guesser of each row may give, C(n, wanted) rows with ``selected_labels``.

    Ranks are dealt to tasks in spans, and a rank is turned into its response by itself.
    """
    ways = g.combinations(F.size("option_labels"), F.col("wanted"))
    last = ways - 1
    spans = keys.where(ways > 0).withColumn("__first", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(SPAN).cast("bigint"))))
    dealt = spans.repartition(keys.sparkSession.sparkContext.defaultParallelism, *keys.columns, "__first")
    ranks = F.sequence(F.col("__first"), F.least(F.col("__first") + (SPAN - 1), last))
    ranked = dealt.withColumn("rank", F.explode(ranks)).drop("__first")
    return ranked.withColumn("selected_labels", g.unrank(F.col("option_labels"), F.col("wanted"), F.col("rank")))


def guessing_calibration(keys: DataFrame) -> DataFrame:
    """Expected credit of a uniform guesser per (options, wanted) shape: every response is graded.

    The key graded against is the shape's least; a uniform guesser meets them all alike.
    """
    shapes = keys.groupBy(F.size("option_labels").alias("options"), "wanted").agg(F.min(F.struct("option_labels", "key")).alias("s"))
    posed = shapes.select("options", "wanted", F.col("s.option_labels").alias("option_labels"), F.col("s.key").alias("correct_labels"))
    graded = grade_items(guessing_space(posed).withColumn("select_count", F.col("wanted")))
    return graded.groupBy("options", "wanted").agg(
        F.count(F.lit(1)).alias("responses"), (F.round(F.avg("credit"), 9) + F.lit(0.0)).alias("expected_credit")
    )
