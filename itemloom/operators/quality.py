"""Constraints as data-quality jobs: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_problems(records: DataFrame, expected_options: int = 4) -> DataFrame:
    """(id, problem) for structural faults and repeated ids or content."""
    n_correct = F.size("correct_labels")

    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    own = F.array_compact(
        F.array(
            F.when(F.size("options") != expected_options, F.concat(F.size("options").cast("string"), F.lit(f" options (expected {expected_options})"))),
            F.when(empty(F.col("prompt_md")), "empty prompt"),
            F.when(empty(F.col("domain")), "empty domain"),
            F.when(empty(F.col("overall_explanation_md")), "empty overall explanation"),
            F.when((F.col("type") == "single_select") & (n_correct != 1), F.concat(F.lit("single_select with "), n_correct.cast("string"), F.lit(" correct"))),
            F.when((F.col("type") == "multi_select") & (n_correct < 2), F.concat(F.lit("multi_select with "), n_correct.cast("string"), F.lit(" correct"))),
        )
    )

    def per_option(field: str, what: str) -> Column:
        bad = F.filter("options", lambda o: empty(o[field]))
        return F.transform(bad, lambda o: F.concat(F.lit("option "), o["label"], F.lit(f": empty {what}")))

    found = records.select(
        "id",
        F.explode(F.concat(own, per_option("text_md", "text"), per_option("explanation_md", "explanation"))).alias("problem"),
    )
    # Copies of one item may be a third of the corpus: combine first, then join back.
    order = F.struct("order_key", "id")
    firsts = (
        records.groupBy("content_hash")
        .agg(F.min_by("id", order).alias("__first"), F.min("order_key").alias("__at"), F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
    )
    copies = (
        records.select("id", "order_key", "content_hash")
        .join(firsts, "content_hash")
        .where(F.col("order_key") != F.col("__at"))
        .select("id", F.concat(F.lit("duplicate content, same as "), F.col("__first")).alias("problem"))
    )
    repeats = (
        records.groupBy("id")
        .agg((F.count(F.lit(1)) - 1).cast("int").alias("again"))
        .where(F.col("again") > 0)
        .select("id", F.explode(F.array_repeat(F.lit("duplicate question id"), F.col("again"))).alias("problem"))
    )
    return found.unionByName(copies).unionByName(repeats)


def not_accepted(df: DataFrame, column: str, values: Iterable[str], nullable: bool = False) -> DataFrame:
    ok = F.col(column).isin(*values)
    return df.where(~F.coalesce(ok, F.lit(nullable)))


def out_of_range(df: DataFrame, column: str, low: int, high: int | None = None) -> DataFrame:
    test = F.col(column) < low
    return df.where(test if high is None else test | (F.col(column) > high))


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    named = parent.select(F.col(key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(named, foreign_key, "left_anti")


def snapshot_drift(old: DataFrame, new: DataFrame, key: str, frozen: Iterable[str], answered: str) -> DataFrame:
    """Answered rows whose frozen columns changed between two versions."""
    frozen = list(frozen)
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in frozen])
    changed = None
    for c in frozen:
        test = ~F.col(c).eqNullSafe(F.col(f"__n_{c}"))
        changed = test if changed is None else changed | test
    return (
        old.where(F.col(answered).isNotNull()).join(n, key).where(changed).drop(*[f"__n_{c}" for c in frozen])
    )


def index_consistency(indexed: DataFrame, question: DataFrame) -> DataFrame:
    """One row: indexed documents, questions, orphans, and whether they agree."""
    both = (
        question.select(F.col("id").alias("question_id"), F.lit(1).alias("q"))
        .join(indexed.groupBy("question_id").agg(F.count(F.lit(1)).alias("i")), "question_id", "full_outer")
        .agg(
            F.coalesce(F.sum("i"), F.lit(0).cast("bigint")).alias("rows_indexed"),
            F.count("q").alias("questions"),
            F.count_if(F.col("q").isNull()).alias("orphans"),
        )
    )
    return both.withColumn(
        "consistent", (F.col("rows_indexed") == F.col("questions")) & (F.col("orphans") == 0)
    )


def several_open_attempts(attempt: DataFrame) -> DataFrame:
    still = F.col("submitted_at").isNull() & F.col("abandoned_at").isNull()
    return (
        attempt.groupBy("certification_id").agg(F.count_if(still).alias("open")).where(F.col("open") > 1)
    )
