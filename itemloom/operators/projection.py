"""Normalise nested question records into tables with content-derived keys.

``records`` follow ``schemas.QUESTION`` plus ``order_key``, a sortable column that says
which record came first in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions import text as tx
from itemloom.schemas import ORIGIN_FOR_PROVIDER

ORDER = "order_key"


def exam_id() -> Column:
    slug = F.nullif(F.col("exam.slug"), F.lit(""))
    return F.when(slug.isNotNull(), F.concat_ws("/", F.col("certification.slug"), slug))


def domain_id() -> Column:
    label = F.nullif(F.col("domain"), F.lit(""))
    return F.when(label.isNotNull(), F.concat_ws("/", F.col("certification.slug"), tx.slugify(label)))


def option_id(question_id: Column, label: Column) -> Column:
    return F.concat_ws("#", question_id, label)


def origin(origins: Mapping[str, str] = ORIGIN_FOR_PROVIDER) -> Column:
    """Explicit origin, else the provider's; NULL means an unknown provider."""
    table = F.create_map(*[F.lit(x) for kv in origins.items() for x in kv])
    return F.coalesce(F.nullif(F.col("origin"), F.lit("")), F.try_element_at(table, F.col("source.provider")))


def unknown_providers(records: DataFrame, origins: Mapping[str, str] = ORIGIN_FOR_PROVIDER) -> DataFrame:
    return records.where(origin(origins).isNull()).select("id", F.col("source.provider").alias("provider"))


def _dimension(records: DataFrame, key: Column, attributes: Mapping[str, Column]) -> DataFrame:
    """First-seen attributes and question count per key; combines before the shuffle."""
    return (
        records.select(key.alias("id"), F.struct(*[c.alias(n) for n, c in attributes.items()]).alias("a"), ORDER)
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min_by("a", ORDER).alias("a"), F.count(F.lit(1)).alias("question_count"))
        .select("id", "a.*", "question_count")
    )


def certification_rows(records: DataFrame) -> DataFrame:
    c = F.col("certification")
    return _dimension(records, c["slug"], {"name": c["name"], "vendor": c["vendor"], "level": c["level"]})


def exam_rows(records: DataFrame) -> DataFrame:
    e = F.col("exam")
    return _dimension(
        records,
        exam_id(),
        {
            "certification_id": F.col("certification.slug"),
            "slug": e["slug"],
            "title": F.coalesce(F.nullif(e["title"], F.lit("")), e["slug"]),
            "number": e["number"],
            "mode": e["mode"],
        },
    )


def domain_rows(records: DataFrame) -> DataFrame:
    return _dimension(
        records,
        domain_id(),
        {
            "certification_id": F.col("certification.slug"),
            "label": F.col("domain"),
            "slug": tx.slugify(F.col("domain")),
        },
    )


def provider_shards(shards: DataFrame) -> DataFrame:
    """First shard path per provider, by index order."""
    return shards.groupBy("provider").agg(F.min_by("path", "ordinal").alias("shard_id"))


def question_rows(
    records: DataFrame, shards: DataFrame | None = None, origins: Mapping[str, str] = ORIGIN_FOR_PROVIDER
) -> DataFrame:
    q = records
    if shards is not None:
        first = provider_shards(shards).select(F.col("provider").alias("__p"), "shard_id")
        q = q.join(first, F.col("source.provider") == F.col("__p"), "left").drop("__p")
    else:
        q = q.withColumn("shard_id", F.lit(None).cast("string"))
    return q.select(
        "id",
        "content_hash",
        F.col("certification.slug").alias("certification_id"),
        exam_id().alias("exam_id"),
        domain_id().alias("domain_id"),
        F.col("domain").alias("domain_label"),
        F.col("exam.question_number").alias("question_number"),
        "type",
        F.coalesce(F.nullif("select_count", F.lit(0)), F.lit(1)).alias("select_count"),
        "prompt_md",
        "overall_explanation_md",
        "correct_labels",
        origin(origins).alias("origin"),
        F.col("source.provider").alias("source_provider"),
        F.col("source.file").alias("source_file"),
        F.col("source.course_url").alias("source_course_url"),
        "shard_id",
        *tx.dedup_hashes(F.col("prompt_md"), F.col("options.text_md")),
    )


def option_rows(records: DataFrame) -> DataFrame:
    return records.select("id", F.posexplode("options").alias("position", "o")).select(
        option_id(F.col("id"), F.col("o.label")).alias("id"),
        F.col("id").alias("question_id"),
        F.col("o.label").alias("label"),
        "position",
        F.col("o.text_md").alias("text_md"),
        F.coalesce(F.col("o.correct"), F.lit(False)).alias("is_correct"),
        F.col("o.explanation_md").alias("explanation_md"),
    )


def citations(
    records: DataFrame, docs_hosts: Iterable[str] | str = (), support_hosts: Iterable[str] | str = ()
) -> DataFrame:
    """Every citation: (question_id, position, raw_url, reference_id)."""
    return records.select(
        F.col("id").alias("question_id"), F.posexplode("references").alias("position", "raw_url")
    ).withColumn("reference_id", tx.normalize_reference(F.col("raw_url"), docs_hosts, support_hosts))


def question_reference_rows(cited: DataFrame) -> DataFrame:
    """First position and its raw URL per (question, reference)."""
    return cited.groupBy("question_id", "reference_id").agg(
        F.min("position").alias("position"), F.min_by("raw_url", "position").alias("raw_url")
    )


def reference_rows(cited: DataFrame) -> DataFrame:
    """Reference dimension: distinct citing questions, least raw URL, its host."""
    per_question = cited.groupBy("reference_id", "question_id").agg(F.min("raw_url").alias("url"))
    return (
        per_question.groupBy("reference_id")
        .agg(F.min("url").alias("display_url"), F.count(F.lit(1)).alias("question_count"))
        .select(
            F.col("reference_id").alias("id"),
            "display_url",
            tx.url_host(F.col("display_url")).alias("host"),
            "question_count",
        )
    )


# -------------------------------------------------------------- blueprints


def blueprint_rows(blueprints: DataFrame) -> DataFrame:
    return blueprints.select(
        "id",
        F.col("certification").alias("certification_id"),
        "vendor",
        "version_label",
        "effective_from",
        "weight_regime",
        "weights_sum",
        "weights_sum_to_100",
        "max_depth",
        F.lit(True).alias("is_current"),
    )


def blueprint_source_rows(blueprints: DataFrame) -> DataFrame:
    return blueprints.select("id", F.explode("sources").alias("s")).select(
        F.concat_ws("#", "id", "s.path").alias("id"), F.col("id").alias("blueprint_id"), "s.*"
    )


def parent_path(path: Column) -> Column:
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", ""))


def blueprint_node_rows(blueprints: DataFrame) -> DataFrame:
    exploded = blueprints.select(F.col("id").alias("blueprint_id"), F.explode("nodes").alias("n"))
    parent = parent_path(F.col("n.path"))
    return exploded.select(
        F.concat_ws("#", "blueprint_id", "n.path").alias("id"),
        "blueprint_id",
        F.when(parent.isNotNull(), F.concat_ws("#", "blueprint_id", parent)).alias("parent_id"),
        "n.*",
    )


def with_blueprint_certifications(certification: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Certifications that only a blueprint knows are added; the corpus wins otherwise."""
    only = (
        blueprints.groupBy(F.col("certification").alias("id"))
        .agg(F.min_by(F.struct("name", "vendor"), "id").alias("b"))
        .join(certification.select("id"), "id", "left_anti")
        .select(
            "id",
            F.coalesce("b.name", "id").alias("name"),
            F.col("b.vendor").alias("vendor"),
            F.lit(None).cast("string").alias("level"),
            F.lit(0).cast("bigint").alias("question_count"),
        )
    )
    return certification.unionByName(only)


def domain_map_rows(domain: DataFrame, blueprint: DataFrame, node: DataFrame) -> DataFrame:
    """Domain -> depth-1 node by exact label within the certification; first node wins."""
    top = (
        node.where(F.col("depth") == 1)
        .join(
            blueprint.select(F.col("id").alias("blueprint_id"), "certification_id"), "blueprint_id"
        )
        .groupBy("certification_id", "label")
        .agg(F.min_by("id", F.struct("blueprint_id", "ordinal")).alias("node_id"))
    )
    return domain.join(top, ["certification_id", "label"]).select(
        F.col("id").alias("domain_id"), "node_id", F.lit("exact").alias("join_method")
    )


# ---------------------------------------------------- detail and snapshots


def question_detail(
    scope: DataFrame, option: DataFrame, question_reference: DataFrame, reference: DataFrame
) -> DataFrame:
    """Scope rows with ordered options[] and references[]; bounded by one record's arrays."""
    options = option.groupBy(F.col("question_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.struct("position", "label", "text_md", "is_correct", "explanation_md"))
        ).alias("options")
    )
    cited = question_reference.join(
        reference.select(F.col("id").alias("reference_id"), "display_url", "host", "question_count"),
        "reference_id",
    )
    refs = cited.groupBy(F.col("question_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("position", "reference_id", "display_url", "host", "raw_url", "question_count")
            )
        ).alias("references")
    )
    return scope.join(options, "id", "left").join(refs, "id", "left")


def snapshot() -> Column:
    """The question as asked, from detail columns; written once, never recomputed."""
    return F.struct(
        F.col("id").alias("question_id"),
        "prompt_md",
        "overall_explanation_md",
        "type",
        "select_count",
        "correct_labels",
        "certification_id",
        "exam_id",
        "domain_label",
        "origin",
        F.transform(
            "options", lambda o: F.struct(o["label"].alias("label"), o["text_md"].alias("text_md"), o["explanation_md"].alias("explanation_md"), o["is_correct"].alias("is_correct"))
        ).alias("options"),
    )


def replay_options(option_order: Column, options: Column, correct: Column, selected: Column) -> Column:
    """Options in the stored permutation with right / missed / wrong / plain."""

    def one(label: Column) -> Column:
        was = F.array_contains(selected, label)
        key = F.array_contains(correct, label)
        state = (
            F.when(key & was, "right").when(key, "missed").when(was, "wrong").otherwise("plain")
        )
        found = F.get(F.filter(options, lambda o: o["label"] == label), 0)
        return F.struct(label.alias("label"), found["text_md"].alias("text_md"), state.alias("state"))

    offered = F.transform(options, lambda o: o["label"])
    return F.transform(F.filter(option_order, lambda x: F.array_contains(offered, x)), one)


def answer_safe(options: Column) -> Column:
    """Options without key or explanations (prunes at the scan)."""
    return F.transform(options, lambda o: F.struct(o["label"].alias("label"), o["text_md"].alias("text_md")))
