"""One definition of "the questions that match", and the facets counted over it."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSPECIFIED = "-"
TYPE_LABELS = {"single_select": "Single select", "multi_select": "Multi select"}


@dataclass(frozen=True)
class SearchFilters:
    """Equality filters, ANDed; ``-`` filters for the absence of a value."""

    certification_id: str | None = None
    exam_id: str | None = None
    domain_id: str | None = None
    domain_label: str | None = None
    type: str | None = None
    origin: str | None = None
    exam_mode: str | None = None
    mark: str | None = None

    def condition(self) -> Column:
        tests = [
            F.col(f.name).isNull() if value == UNSPECIFIED else F.col(f.name) == value
            for f in fields(self)
            if (value := getattr(self, f.name)) is not None
        ]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def live_mark(value: Column, cleared: str = "cleared") -> Column:
    """A cleared or empty mark is no mark."""
    return F.nullif(F.nullif(value, F.lit(cleared)), F.lit(""))


def question_scope(
    question: DataFrame,
    exam: DataFrame,
    certification: DataFrame,
    current_mark: DataFrame,
    filters: SearchFilters = SearchFilters(),
    *,
    matches: DataFrame | None = None,
    cleared: str = "cleared",
) -> DataFrame:
    """Questions with exam, certification and mark attached; never drops a question.

    ``matches`` (question_id, ...) restricts to text-search hits and keeps its columns.
    """
    q = question
    if matches is not None:
        q = matches.join(q, matches["question_id"] == q["id"], "inner").drop(matches["question_id"])
    joined = (
        q.join(
            exam.select(
                F.col("id").alias("exam_id"), F.col("title").alias("exam_title"), F.col("mode").alias("exam_mode")
            ),
            "exam_id",
            "left",
        )
        .join(
            certification.select(
                F.col("id").alias("certification_id"), F.col("name").alias("certification_name")
            ),
            "certification_id",
            "left",
        )
        .join(
            current_mark.select(
                F.col("question_id").alias("id"), live_mark(F.col("value"), cleared).alias("mark")
            ),
            "id",
            "left",
        )
    )
    return joined.where(filters.condition())


# facet name -> (value column, label column, SearchFilters field)
FACETS = {
    "certification": ("certification_id", "certification_name", "certification_id"),
    "exam": ("exam_id", "exam_title", "exam_id"),
    "mode": ("exam_mode", "exam_mode", "exam_mode"),
    "domain": ("domain_label", "domain_label", "domain_label"),
    "type": ("type", "type", "type"),
    "mark": ("mark", "mark", "mark"),
}


def facet_label(name: Column, value: Column, label: Column) -> Column:
    shown = reduce(
        lambda acc, kv: acc.when((name == "type") & (value == kv[0]), F.lit(kv[1])),
        TYPE_LABELS.items(),
        F.when(value.isNull() & (name == "mark"), F.lit("unmarked")).when(
            value.isNull(), F.lit("unspecified")
        ),
    )
    return shown.otherwise(F.coalesce(F.nullif(label, F.lit("")), value))


def facets(scope: DataFrame, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """Every facet in one aggregation: one scan, one shuffle of already-combined counts."""
    dims = [v for v, _, _ in FACETS.values()]
    labels = {v: lab for v, lab, _ in FACETS.values()}
    narrow = scope.select(
        *dims, *[F.col(labels[d]).alias(f"__l_{d}") for d in dims if labels[d] != d]
    )
    grouped = narrow.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.min(F.col(f"__l_{d}" if labels[d] != d else d)).alias(f"__m_{d}")
            for d in dims
            if labels[d] != d
        ],
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )

    def pick(make) -> Column:
        out = None
        for name, (d, _, _) in FACETS.items():
            test = F.col(f"__g_{d}") == 0
            out = F.when(test, make(name, d)) if out is None else out.when(test, make(name, d))
        return out

    shaped = grouped.select(
        pick(lambda n, d: F.lit(n)).alias("facet"),
        pick(lambda n, d: F.col(d)).alias("raw"),
        pick(lambda n, d: F.col(f"__m_{d}") if labels[d] != d else F.col(d)).alias("raw_label"),
        "n",
    )
    chosen = {n: getattr(filters, f) for n, (_, _, f) in FACETS.items()}
    selected = reduce(
        lambda acc, kv: acc | ((F.col("facet") == kv[0]) & (F.coalesce("raw", F.lit(UNSPECIFIED)) == kv[1])),
        [kv for kv in chosen.items() if kv[1] is not None],
        F.lit(False),
    )
    return shaped.select(
        "facet",
        F.coalesce("raw", F.lit(UNSPECIFIED)).alias("value"),
        facet_label(F.col("facet"), F.col("raw"), F.col("raw_label")).alias("label"),
        "n",
        selected.alias("selected"),
    )


def all_terms_filter(rows: DataFrame, terms: str, **equals: str) -> DataFrame:
    """Substring filter over export rows: every term present, plus equality filters."""
    wanted = [t for t in terms.lower().split() if t]
    test = reduce(lambda a, t: a & F.col("search").contains(t), wanted, F.lit(True))
    for column, value in equals.items():
        if column == "mark" and value == "unmarked":
            test &= F.coalesce(F.col("mark"), F.lit("")) == ""
        else:
            test &= F.col(column) == value
    return rows.where(test)


def keyed_lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``: one semi join whatever the list's length."""
    return rows.join(ids.select(key), key, "left_semi")


def current_mark_lookup(ids: DataFrame, current_mark: DataFrame, cleared: str = "cleared") -> DataFrame:
    """Live marks of the listed questions; unmarked ones are absent."""
    return (
        current_mark.join(ids.select("question_id"), "question_id", "left_semi")
        .select("question_id", live_mark(F.col("value"), cleared).alias("value"))
        .where(F.col("value").isNotNull())
    )


def page(scored: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One ranked page; a bounded top-k, not a full sort."""
    return scored.orderBy("score", "question_id").offset(max(0, offset)).limit(max(0, limit))


DEFAULT_PER_PAGE, MAX_PER_PAGE = 25, 100


def clamp_page(total: Column, page_no: Column, per_page: Column) -> Column:
    """Clamped paging numbers: page, pages, first and last row."""
    size = F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(per_page, F.lit(0)), F.lit(DEFAULT_PER_PAGE)), F.lit(MAX_PER_PAGE))).cast("bigint")
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(total / size).cast("bigint"))
    shown = F.least(pages, F.greatest(F.lit(1).cast("bigint"), F.coalesce(page_no, F.lit(1)).cast("bigint")))
    return F.struct(
        size.alias("per_page"),
        pages.alias("pages"),
        shown.alias("page"),
        F.when(total == 0, F.lit(0).cast("bigint")).otherwise((shown - 1) * size + 1).alias("first_row"),
        F.least(shown * size, total).alias("last_row"),
        (shown > 1).alias("has_previous"),
        (shown < pages).alias("has_next"),
    )
