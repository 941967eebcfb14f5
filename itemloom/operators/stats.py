"""Corpus statistics over canonical records.

Lengths and counts are reduced to scalars inside each row before any shuffle, so the
aggregations move a few integers per group, never text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import text as tx
from itemloom.session import cut_lineage

# ---- fixed values: histogram edges in characters, last bin open ----
LENGTH_BINS = {
    "prompt": (0, 150, 250, 350, 450, 550, 700, 900),
    "option": (0, 40, 70, 100, 130, 160, 200, 250),
    "explanation": (0, 500, 1000, 1500, 2000, 2500, 3000, 4000),
}
ANSWER_LABELS = ("A", "B", "C", "D")


def measured(records: DataFrame) -> DataFrame:
    """Records with their keys and length scalars; arrays are summed in place."""

    def total(field: str) -> Column:
        return F.aggregate(
            F.transform("options", lambda o: F.length(F.coalesce(o[field], F.lit(""))).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        )

    return records.select(
        "id",
        "order_key",
        F.col("certification.slug").alias("certification_id"),
        F.col("exam.slug").alias("exam_slug"),
        F.col("exam.title").alias("exam_title"),
        F.col("exam.mode").alias("exam_mode"),
        F.col("domain").alias("domain_label"),
        "type",
        F.length(F.coalesce("prompt_md", F.lit(""))).cast("bigint").alias("prompt_chars"),
        F.length(F.coalesce("overall_explanation_md", F.lit(""))).cast("bigint").alias("explanation_chars"),
        F.size("options").cast("bigint").alias("n_options"),
        total("text_md").alias("option_chars"),
        total("explanation_md").alias("option_explanation_chars"),
        F.size("references").alias("n_references"),
    )


def _mean(total: str, count: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(F.sum(total), count), F.lit(0.0)), 1)


def profile_columns() -> list[Column]:
    """Counts, type split and length profile of a group of measured questions."""
    n, options = F.count(F.lit(1)), F.sum("n_options")
    return [
        n.alias("questions"),
        F.count_if(F.col("type") == "single_select").alias("single_select"),
        F.count_if(F.col("type") == "multi_select").alias("multi_select"),
        _mean("prompt_chars", n).alias("prompt_mean"),
        _mean("option_chars", options).alias("option_mean"),
        _mean("explanation_chars", n).alias("explanation_mean"),
        _mean("option_explanation_chars", options).alias("option_explanation_mean"),
        F.sum(
            F.col("prompt_chars") + F.col("option_chars") + F.col("explanation_chars") + F.col("option_explanation_chars")
        ).alias("total_chars"),
    ]


def domain_profiles(m: DataFrame) -> DataFrame:
    return m.groupBy("certification_id", "domain_label").agg(*profile_columns())


def exam_profiles(m: DataFrame) -> DataFrame:
    """Per exam, with the title and mode of its first record."""
    first = F.min_by(F.struct("exam_title", "exam_mode"), "order_key")
    return (
        m.groupBy("certification_id", "exam_slug")
        .agg(first.alias("f"), *profile_columns())
        .select("certification_id", "exam_slug", "f.exam_title", "f.exam_mode", *_profile_names())
    )


def _profile_names() -> list[str]:
    return (
        "questions single_select multi_select prompt_mean option_mean explanation_mean "
        "option_explanation_mean total_chars"
    ).split()


def mode_profiles(m: DataFrame) -> DataFrame:
    """Per (certification, mode), missing mode called standard."""
    keyed = m.withColumn("mode", F.coalesce(F.nullif("exam_mode", F.lit("")), F.lit("standard")))
    share = F.count_if(F.col("type") == "multi_select") / F.count(F.lit(1)) * 100
    return keyed.groupBy("certification_id", "mode").agg(
        *profile_columns(), F.countDistinct("exam_slug").alias("exams"), F.bround(share, 1).alias("multi_select_pct")
    )


def certification_summary(m: DataFrame) -> DataFrame:
    """Distinct exams and domains through one pre-grouped pass, safe on a hot certification."""
    cells = m.groupBy("certification_id", "exam_slug", "domain_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("type") == "single_select").alias("s"),
        F.count_if(F.col("type") == "multi_select").alias("x"),
    )
    return cells.groupBy("certification_id").agg(
        F.sum("n").alias("questions"),
        F.countDistinct("exam_slug").alias("exams"),
        F.countDistinct("domain_label").alias("domains"),
        F.sum("s").alias("single_select"),
        F.sum("x").alias("multi_select"),
    )


def totals(m: DataFrame, cited: DataFrame) -> DataFrame:
    cells = m.groupBy("certification_id", "exam_slug", "domain_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_options").alias("o"),
        F.sum(F.col("prompt_chars") + F.col("option_chars") + F.col("explanation_chars") + F.col("option_explanation_chars")).alias("c"),
    )
    none = F.lit("")
    corpus = cells.agg(
        F.sum("n").alias("questions"),
        F.countDistinct("certification_id").alias("certifications"),
        F.countDistinct("certification_id", F.coalesce("domain_label", none)).alias("domains"),
        F.countDistinct("certification_id", F.coalesce("exam_slug", none)).alias("exams"),
        F.sum("o").alias("options"),
        F.sum("c").alias("corpus_chars"),
    )
    pages = cited.groupBy("reference_id").agg(F.count(F.lit(1)).alias("k"))
    return corpus.select(
        "*",
        pages.agg(F.count(F.lit(1))).scalar().alias("references"),
        pages.agg(F.coalesce(F.sum("k"), F.lit(0).cast("bigint"))).scalar().alias("reference_citations"),
    )


def coverage_cells(m: DataFrame) -> DataFrame:
    """Non-zero cells of the domain x exam matrix."""
    return m.groupBy("certification_id", "domain_label", "exam_slug").agg(F.count(F.lit(1)).alias("n"))


def coverage_matrix(m: DataFrame) -> DataFrame:
    """One row per (certification, domain): zero-filled counts over the sorted exams."""
    cells = coverage_cells(m).where(F.col("exam_slug").isNotNull() & F.col("domain_label").isNotNull())
    axis = cells.groupBy("certification_id").agg(F.array_sort(F.collect_set("exam_slug")).alias("exams"))
    rows = cells.groupBy("certification_id", "domain_label").agg(
        F.map_from_entries(F.collect_list(F.struct("exam_slug", "n"))).alias("by_exam")
    )
    zero = F.lit(0).cast("bigint")
    return rows.join(axis, "certification_id").select(
        "certification_id",
        "domain_label",
        "exams",
        F.transform("exams", lambda e: F.coalesce(F.try_element_at("by_exam", e), zero)).alias("counts"),
    )


def answer_positions(records: DataFrame, labels: Sequence[str] = ANSWER_LABELS) -> DataFrame:
    """Correct-answer counts per label against an even spread; one pass, no explode."""
    counted = records.agg(
        F.sum(F.size("correct_labels").cast("bigint")).alias("total"),
        *[F.count_if(F.array_contains("correct_labels", x)).alias(f"n_{x}") for x in labels],
    )
    expected = F.col("total") / len(labels)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"n_{x}").alias("count")) for x in labels]))
    return counted.select("total", rows.alias("r")).select(
        "r.label",
        "r.count",
        F.bround(expected, 1).alias("expected"),
        (F.col("r.count") - expected).alias("deviation"),
        F.bround(F.coalesce(F.try_divide((F.col("r.count") - expected) * 100, expected), F.lit(0.0)), 1).alias("deviation_pct"),
    )


def histogram(values: DataFrame, column: str, edges: Sequence[int], weight: Column | None = None) -> DataFrame:
    """Fixed-edge bins, last one open, empty bins kept; one pass."""
    bounds = list(zip(edges, [*edges[1:], None]))
    v = F.col(column)

    def inside(low: int, high: int | None) -> Column:
        return (v >= low) if high is None else (v >= low) & (v < high)

    counted = values.agg(*[F.count_if(inside(lo, hi)).alias(f"b{lo}") for lo, hi in bounds])
    bins = F.array(
        *[
            F.struct(
                F.lit(f"{lo}+" if hi is None else f"{lo}-{hi - 1}").alias("label"),
                F.lit(lo).alias("low"),
                F.lit(hi).cast("int").alias("high"),
                F.col(f"b{lo}").alias("count"),
            )
            for lo, hi in bounds
        ]
    )
    return counted.select(F.explode(bins).alias("b")).select("b.*")


def reference_density(m: DataFrame) -> DataFrame:
    return m.groupBy(F.col("n_references").alias("references")).agg(F.count(F.lit(1)).alias("questions"))


def citation_index(cited: DataFrame, key: str = "reference_id") -> DataFrame:
    """Per page: citations, spellings, canonical (shortest, then least) URL, section.

    ``cited`` has question_id, raw_url, certification_id, domain_label.  The first
    aggregation cuts repeats, so distinct counts never gather one page's citations.
    """
    pre = cited.groupBy(key, "raw_url", "certification_id", "domain_label").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct(F.length("raw_url").alias("chars"), F.col("raw_url").alias("url"))
    return (
        pre.groupBy(key)
        .agg(
            F.sum("n").alias("citations"),
            F.countDistinct("raw_url").alias("variants"),
            F.countDistinct("certification_id").alias("certifications"),
            F.countDistinct("certification_id", F.coalesce("domain_label", F.lit(""))).alias("domains"),
            F.min(best).alias("best"),
        )
        .select(
            F.col(key).alias("key"), F.col("best.url").alias("url"), "citations", "variants", "certifications", "domains"
        )
        .withColumn("section", tx.reference_section(F.col("key")))
    )


def citation_members(cited: DataFrame, key: str = "reference_id") -> DataFrame:
    """Which questions cite which page, long form."""
    return cited.groupBy(F.col(key).alias("key"), "question_id").agg(F.count(F.lit(1)).alias("times"))


def reference_sections(index: DataFrame) -> DataFrame:
    return index.groupBy("section").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("citations").alias("citations")
    )


def top_domain_references(cited: DataFrame, k: int = 5) -> DataFrame:
    """Top-k pages per domain; the literal rank bound lets Spark trim before the shuffle."""
    counts = cited.groupBy("certification_id", "domain_label", "reference_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("certification_id", "domain_label").orderBy(F.desc("n"), "reference_id")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_references(reference: DataFrame, limit: int = 10) -> DataFrame:
    return reference.orderBy(F.desc("question_count"), "id").limit(limit)


def domain_tokens(
    records: DataFrame, domain: Column, text: Column, stop_words: Iterable[str] = ()
) -> DataFrame:
    """(domain, term, n): combined before the shuffle, in parts of a size, so a task holds the terms of one."""
    word = F.rtrim(F.col("raw"), F.lit(".-_"))
    dealt = records.select(domain.alias("domain"), text.alias("text")).hint("rebalance")
    rows = dealt.select("domain", F.explode(tx.raw_terms(F.col("text"))).alias("raw"))
    kept = rows.select("domain", word.alias("term")).where(F.length("term") > 2)
    stop = sorted(set(stop_words))
    if stop:
        kept = kept.where(~F.col("term").isin(*stop))
    return kept.groupBy("domain", "term").agg(F.count(F.lit(1)).alias("n"))


def distinctive_terms(counts: DataFrame, limit: int = 12, min_count: int = 3, domains: DataFrame | None = None) -> DataFrame:
    """tf-idf fingerprint per domain: n * ln(D / df), plurals folded when the singular occurs.

    D counts ``domains`` (a column ``domain``), those without a term included; where none are
    given, the domains of the counts.  The fold is a single step: ``xss`` becomes ``xs`` at most.
    """
    counts = cut_lineage(counts)  # read by the vocabulary, the fold and the domain count
    vocabulary = counts.select(F.col("term").alias("singular")).distinct()
    # Only plurals look for a singular: all other terms would meet under one empty key.
    is_plural = F.col("term").endswith("s")
    plural = counts.where(is_plural).withColumn("__s", F.regexp_replace("term", "s$", ""))
    met = plural.join(vocabulary, F.col("__s") == F.col("singular"), "left").select("domain", F.coalesce("singular", "term").alias("term"), "n")
    folded = met.unionByName(counts.where(~is_plural).select("domain", "term", "n")).groupBy("domain", "term").agg(F.sum("n").alias("n"))
    total = (counts if domains is None else domains).agg(F.countDistinct("domain")).scalar()
    spread = folded.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    scored = spread.where((F.col("n") >= min_count) & (F.col("df") < total)).withColumn(
        "score", F.col("n") * F.log(total / F.col("df"))
    )
    w = Window.partitionBy("domain").orderBy(F.desc("score"), "term")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
        .select("domain", "rank", "term", F.round("score", 3).alias("score"), F.col("n").alias("count"))
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def group_counts(question: DataFrame, *keys: str, drop_null: bool = False) -> DataFrame:
    rows = question.where(F.col(keys[0]).isNotNull()) if drop_null else question
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def expected_fields(records: DataFrame) -> DataFrame:
    """Prompt and overall explanation, plus text and explanation per option."""
    return records.agg(F.sum((2 + 2 * F.size("options")).cast("bigint")).alias("fields"))


def declared_counts(index: DataFrame, records: DataFrame) -> DataFrame:
    """Declared lines against loaded records per provider."""
    declared = index.groupBy("provider").agg(F.sum("line_count").alias("declared"))
    loaded = records.groupBy(F.col("source.provider").alias("provider")).agg(F.count(F.lit(1)).alias("loaded"))
    zero = F.lit(0).cast("bigint")
    return declared.join(loaded, "provider", "full_outer").select(
        "provider",
        F.coalesce("declared", zero).alias("declared"),
        F.coalesce("loaded", zero).alias("loaded"),
        F.col("declared").eqNullSafe(F.col("loaded")).alias("agrees"),
    )
