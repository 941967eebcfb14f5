"""Blueprint weights: published against observed shares, and which weights to use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_PP = 0.7
OFFICIAL, CORPUS, NONE = "official", "corpus", "none"


def current_blueprint(blueprint: DataFrame) -> DataFrame:
    """The current blueprint per certification, least id first."""
    return (
        blueprint.where("is_current")
        .groupBy("certification_id")
        .agg(F.min("id").alias("blueprint_id"))
    )


def certifications_with_blueprints(blueprint: DataFrame) -> DataFrame:
    return blueprint.where("is_current").select("certification_id").distinct()


def _top_nodes(blueprint: DataFrame, node: DataFrame) -> DataFrame:
    return (
        node.where(F.col("depth") == 1)
        .join(current_blueprint(blueprint), "blueprint_id")
        .select("certification_id", F.col("id").alias("node_id"), "label", "weight_pct")
    )


def weights_for(blueprint: DataFrame, node: DataFrame, domain_map: DataFrame) -> DataFrame:
    """(certification_id, domain_id, weight) of exact blueprints."""
    return (
        _top_nodes(blueprint, node)
        .where(F.col("weight_pct").isNotNull())
        .join(domain_map.select("domain_id", "node_id"), "node_id")
        .select("certification_id", "domain_id", F.col("weight_pct").alias("weight"))
    )


def resolve_weights(domain: DataFrame, official: DataFrame) -> DataFrame:
    """Official weights where a certification has any, else its positive question counts."""
    has = official.select("certification_id").distinct()
    fallback = (
        domain.where(F.col("question_count") > 0)
        .join(has, "certification_id", "left_anti")
        .select(
            "certification_id",
            F.col("id").alias("domain_id"),
            F.col("question_count").cast("double").alias("weight"),
            F.lit(CORPUS).alias("source"),
        )
    )
    return official.select(
        "certification_id", "domain_id", F.col("weight").cast("double").alias("weight"), F.lit(OFFICIAL).alias("source")
    ).unionByName(fallback)


def cross_check(
    domain: DataFrame, blueprint: DataFrame, node: DataFrame, domain_map: DataFrame
) -> DataFrame:
    """Published against observed share per joined domain, in percentage points."""
    joined = (
        _top_nodes(blueprint, node)
        .join(domain_map.select("domain_id", "node_id"), "node_id")
        .join(domain.select(F.col("id").alias("domain_id"), "question_count"), "domain_id")
    )
    # One row per domain: the window holds a domain list, not questions.
    total = F.sum("question_count").over(Window.partitionBy("certification_id"))
    share = F.bround(F.coalesce(F.try_divide(F.col("question_count") * 100.0, total), F.lit(0.0)), 4)
    deviation = F.bround(F.abs(F.col("corpus_pct") - F.col("published_pct")), 4)
    return (
        joined.select(
            "certification_id", "domain_id", "label", F.col("weight_pct").alias("published_pct"), "question_count", share.alias("corpus_pct")
        )
        .withColumn("deviation_pp", deviation)
        .withColumn(
            "within_tolerance", F.coalesce(F.col("deviation_pp") <= TOLERANCE_PP + 1e-9, F.lit(True))
        )
    )


def cross_check_summary(rows: DataFrame, unjoined: DataFrame) -> DataFrame:
    """Per certification: questions, worst deviation, tolerance and clean join."""
    loose = unjoined.groupBy("certification_id").agg(F.count(F.lit(1)).alias("loose"))
    return (
        rows.groupBy("certification_id")
        .agg(
            F.count(F.lit(1)).alias("domains"),
            F.sum("question_count").alias("questions"),
            F.max("deviation_pp").alias("worst_deviation_pp"),
            F.bool_and("within_tolerance").alias("within_tolerance"),
        )
        .join(loose, "certification_id", "full_outer")
        .select(
            "certification_id",
            F.coalesce("domains", F.lit(0).cast("bigint")).alias("domains"),
            F.coalesce("questions", F.lit(0).cast("bigint")).alias("questions"),
            "worst_deviation_pp",
            F.coalesce("within_tolerance", F.lit(True)).alias("within_tolerance"),
            F.col("loose").isNull().alias("joined_cleanly"),
        )
    )


def unjoined(domain: DataFrame, blueprint: DataFrame, node: DataFrame, domain_map: DataFrame) -> DataFrame:
    """Domains without a node and top nodes without a domain."""
    covered = blueprint.where("is_current").select("certification_id").distinct()
    lone_domains = (
        domain.join(covered, "certification_id", "left_semi")
        .join(domain_map.select(F.col("domain_id").alias("id")), "id", "left_anti")
        .select("certification_id", F.lit("domain").alias("side"), "label")
    )
    lone_nodes = (
        _top_nodes(blueprint, node)
        .join(domain_map.select("node_id"), "node_id", "left_anti")
        .select("certification_id", F.lit("node").alias("side"), "label")
    )
    return lone_domains.unionByName(lone_nodes)
