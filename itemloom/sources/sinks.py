"""Canonical sinks and exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from itemloom.functions import text as tx
from itemloom.operators import diff

TYPE_PROMPTS = {"single_select": "Select ONE", "multi_select": "Select TWO or more"}


def search_export(records: DataFrame) -> DataFrame:
    """One denormalised, lower-cased, whitespace-collapsed search row per question."""
    body = F.concat_ws(
        " ", "prompt_md", "domain_label", F.col("id").cast("string"), F.array_join("options.text_md", " ")
    )
    return records.select(
        "id",
        F.col("certification_id").alias("cert"),
        F.col("domain_label").alias("domain"),
        F.col("exam_id").alias("exam"),
        "type",
        F.regexp_replace(F.lower(body), r"\s+", " ").alias("search"),
    )


def study_index(records: DataFrame) -> DataFrame:
    """Per certification: numbered domains with counts by type and their file names."""
    from pyspark.sql import Window

    per = records.groupBy("certification_id", "domain_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("type") == "single_select").alias("single"),
    )
    # One row per domain here, so the window holds a domain list, not questions.
    w = Window.partitionBy("certification_id").orderBy("domain_label")
    number = F.row_number().over(w)
    return per.withColumn("position", number).select(
        "certification_id",
        "position",
        "domain_label",
        "n",
        "single",
        (F.col("n") - F.col("single")).alias("multi"),
        F.concat(
            F.when(F.col("position") < 10, F.lit("0")).otherwise(F.lit("")),
            F.col("position").cast("string"),
            F.lit("-"),
            tx.slugify(F.col("domain_label")),
            F.lit(".md"),
        ).alias("filename"),
    )


def quote_block(text: Column, prefix: str = "> ") -> Column:
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.when(line == "", F.lit(prefix.rstrip())).otherwise(F.concat(F.lit(prefix), line)),
    )
    return F.array_join(lines, "\n")


def render_question() -> Column:
    """Self-quiz Markdown of one record."""
    nl = F.lit("\n")
    kind = F.when(F.col("type") == "multi_select", TYPE_PROMPTS["multi_select"]).otherwise(TYPE_PROMPTS["single_select"])
    options = F.array_join(
        F.transform("options", lambda o: F.concat(F.lit("- **"), o["label"], F.lit(".** "), F.coalesce(o["text_md"], F.lit("")))), "\n"
    )
    answers = F.array_join(
        F.transform(
            "options",
            lambda o: F.concat(
                F.lit("**"),
                F.when(o["correct"], "✅").otherwise("❌"),
                F.lit(" "),
                o["label"],
                F.lit(". "),
                F.coalesce(o["text_md"], F.lit("")),
                F.lit("**\n\n"),
                quote_block(F.coalesce(o["explanation_md"], F.lit(""))),
                nl,
            ),
        ),
        "\n",
    )
    refs = F.when(
        F.size("references") > 0,
        F.concat(
            F.lit("**References**\n\n"),
            F.array_join(F.transform("references", lambda u: F.concat(F.lit("- <"), u, F.lit(">"))), "\n"),
            nl,
            nl,
        ),
    ).otherwise("")
    return F.concat(
        F.lit("### "), F.col("id"), F.lit("\n\n`"), kind, F.lit("` · "),
        F.coalesce(F.col("exam.title"), F.lit("")), F.lit(" · question "),
        F.coalesce(F.col("exam.question_number").cast("string"), F.lit("")), F.lit("\n\n"),
        F.coalesce("prompt_md", F.lit("")), F.lit("\n\n"), options,
        F.lit("\n\n<details>\n<summary>Answer: <b>"), F.array_join("correct_labels", ", "),
        F.lit("</b></summary>\n\n"), answers, F.lit("\n**Overall explanation**\n\n"),
        quote_block(F.coalesce("overall_explanation_md", F.lit(""))), F.lit("\n\n"), refs, F.lit("</details>\n"),
    )


def study_rows(records: DataFrame) -> DataFrame:
    """Rendered questions with the keys that place them in their study document."""
    return records.select(
        F.col("certification.slug").alias("certification_id"),
        F.col("domain").alias("domain_label"),
        F.col("exam.number").alias("exam_number"),
        F.col("exam.question_number").alias("question_number"),
        "id",
        render_question().alias("body"),
    )


def write_study(records: DataFrame, path: str) -> None:
    """One text folder per (certification, domain), rows in reading order.

    Range partitioning keeps a domain of any size in several ordered files.
    """
    order = ["certification_id", "domain_label", "exam_number", "question_number", "id"]
    (
        study_rows(records)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("certification_id", "domain_label", "body")
        .write.mode("overwrite")
        .partitionBy("certification_id", "domain_label")
        .text(path, lineSep="---\n\n")
    )


def write_records(records: DataFrame, path: str, order: str = "id", fmt: str = "json") -> None:
    """Canonical JSON lines (or parquet), partitioned by certification, ordered by key."""
    (
        records.withColumn("cert", F.col("certification.slug"))
        .repartitionByRange("cert", order)
        .sortWithinPartitions("cert", order)
        .write.mode("overwrite")
        .partitionBy("cert")
        .format(fmt)
        .save(path)
    )


VERSION = "run_id STRING, seq BIGINT, rows BIGINT, path STRING"


def versions(spark, base: str) -> DataFrame:
    """A row for each complete version of a table; none before the first."""
    try:
        return spark.read.schema(VERSION).parquet(f"{base.rstrip('/')}_versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION)


def publish_version(table: DataFrame, base: str, run_id: str) -> str:
    """Write a version beside the old ones, then its completion record: readers never see half.

    Nothing is overwritten: every attempt has a folder of its own, and what a failed one
    left has no record.  A run that is already complete is refused.
    """
    spark, base = table.sparkSession, base.rstrip("/")
    done = versions(spark, base)
    if not done.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is published")
    target = f"{base}/run_id={run_id}/{uuid.uuid4().hex}"
    table.write.parquet(target)
    seq = (done.agg(F.max("seq")).first()[0] or 0) + 1
    record = spark.createDataFrame([(run_id, seq, spark.read.parquet(target).count(), target)], VERSION)
    record.coalesce(1).write.mode("append").parquet(f"{base}_versions")
    return target


def read_current(spark, base: str) -> DataFrame | None:
    """The newest complete version of a table; None before the first."""
    newest = versions(spark, base).agg(F.max_by("path", F.struct("seq", "run_id"))).first()[0]
    return None if newest is None else spark.read.parquet(newest)


def publish_changes(desired: DataFrame, base: str, run_id: str, keys: Sequence[str]) -> str | None:
    """Make ``desired`` the current version, or write nothing where it already is; None then.

    Repeated keys are refused (``diff.duplicate_keys`` lists them).
    """
    if not diff.duplicate_keys(desired, keys).isEmpty():
        raise ValueError(f"keys {', '.join(keys)} repeat")
    current = read_current(desired.sparkSession, base)
    if current is not None and diff.changed_rows(desired, current, keys).isEmpty():
        return None
    stamp = F.lit(run_id)
    return publish_version(desired.withColumn("ingest_run_id", stamp), base, run_id)


def manifest_totals(records: DataFrame) -> DataFrame:
    """Totals block of the manifest, one row."""
    return records.agg(
        F.countDistinct("certification.slug", F.coalesce("exam.slug", F.lit(""))).alias("exams"),
        F.count(F.lit(1)).alias("questions"),
        F.sum(F.size("options").cast("bigint")).alias("options"),
    )
