"""Queries: scope, filters, facets, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.operators import scope as S
from itemloom.operators import state
from itemloom.plans import bindings as B
from itemloom.plans.registry import query

WITH_SCOPE = f"WITH {B.SCOPE}"


def _scope(bank: B.Bank, filters: S.SearchFilters = S.SearchFilters()):
    return S.question_scope(
        bank.question, bank.exam, bank.certification, state.current_mark(bank.mark), filters, cleared=B.CLEARED
    )


def _facet_sql(where: str = "TRUE", selected: str = "FALSE") -> str:
    dims = [
        ("certification", "certification_id", "certification_name", "'unspecified'"),
        ("exam", "exam_id", "exam_title", "'unspecified'"),
        ("mode", "exam_mode", "exam_mode", "'unspecified'"),
        ("domain", "domain_label", "domain_label", "'unspecified'"),
        ("type", "type", "CASE type WHEN 'single_select' THEN 'Single select' WHEN 'multi_select' THEN 'Multi select' ELSE type END", "'unspecified'"),
        ("mark", "mark", "mark", "'unmarked'"),
    ]
    parts = [
        f"SELECT '{n}' AS facet, coalesce({v}, '-') AS value, coalesce(min({lab}), {v}, {missing}) AS label, "
        f"count(*) AS n FROM picked GROUP BY {v}"
        for n, v, lab, missing in dims
    ]
    return (
        f"{WITH_SCOPE}, picked AS (SELECT * FROM scope WHERE {where}) "
        f"SELECT facet, value, label, n, {selected} AS selected FROM ({' UNION ALL '.join(parts)})"
    )


@query("facets_all", _facet_sql())
def facets_all(bank):
    return S.facets(_scope(bank))


@query(
    "facets_filtered",
    _facet_sql(
        "certification_id = 'en' AND type IS NULL",
        "(facet = 'certification' AND value = 'en') OR (facet = 'type' AND value = '-')",
    ),
)
def facets_filtered(bank):
    filters = S.SearchFilters(certification_id="en", type=S.UNSPECIFIED)
    return S.facets(_scope(bank, filters), filters)


@query(
    "facet_totals_agree",
    f"{WITH_SCOPE} SELECT count(*) AS total, 6::BIGINT AS facets_equal_to_total FROM scope",
)
def facet_totals_agree(bank):
    per = S.facets(_scope(bank)).groupBy("facet").agg(F.sum("n").alias("n"))
    return per.agg(F.max("n").alias("total"), F.count_if(F.col("n") == F.lit(_scalar_max(per))).alias("facets_equal_to_total"))


def _scalar_max(per):
    return per.select(F.max("n")).scalar()


@query(
    "scope_filtered",
    f"""{WITH_SCOPE} SELECT id, certification_name, exam_title, exam_mode, domain_label, mark FROM scope
    WHERE certification_id = 'fr' AND domain_label = 'Medium, plain' AND origin = 'official_sample' AND exam_mode = 'hard'""",
)
def scope_filtered(bank):
    f = S.SearchFilters(
        certification_id="fr", domain_label="Medium, plain", origin="official_sample", exam_mode="hard"
    )
    return _scope(bank, f).select("id", "certification_name", "exam_title", "exam_mode", "domain_label", "mark")


@query(
    "scope_filter_for_absence",
    f"{WITH_SCOPE} SELECT id, certification_id, type, exam_id FROM scope WHERE exam_mode IS NULL AND mark IS NULL",
)
def scope_filter_for_absence(bank):
    f = S.SearchFilters(exam_mode=S.UNSPECIFIED, mark=S.UNSPECIFIED)
    return _scope(bank, f).select("id", "certification_id", "type", "exam_id")


@query(
    "scope_by_mark_and_exam",
    f"{WITH_SCOPE} SELECT exam_id, mark, count(*) AS n FROM scope WHERE mark = 'click' AND type = 'single_select' GROUP BY exam_id, mark",
)
def scope_by_mark_and_exam(bank):
    f = S.SearchFilters(mark="click", type="single_select")
    return _scope(bank, f).groupBy("exam_id", "mark").agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalised_marks",
    f"""WITH {B.CURRENT_MARK} SELECT question_id, nullif(value, 'error') AS mark FROM current_mark""",
)
def normalised_marks(bank):
    current = state.current_mark(bank.mark)
    return current.select("question_id", S.live_mark(F.col("value"), B.CLEARED).alias("mark"))


@query(
    "export_rows",
    f"""WITH {B.QUESTION}, lines AS (SELECT id, exam_id, certification_id, domain_label, type, prompt_md,
      string_split(prompt_md, chr(10)) AS parts FROM question)
    SELECT id, certification_id AS cert, domain_label AS domain, exam_id AS exam, type,
      regexp_replace(lower(concat_ws(' ', parts[1], domain_label, id::VARCHAR, array_to_string(parts[2:], ' '))), '\\s+', ' ', 'g') AS search
    FROM lines""",
)
def export_rows(bank):
    return _export(bank).select("id", "cert", "domain", "exam", "type", "search")


def _export(bank):
    from itemloom.sources.sinks import search_export

    q = bank.question
    parts = F.split("prompt_md", "\n")
    records = q.select(
        "id",
        "certification_id",
        "exam_id",
        "domain_label",
        "type",
        parts[0].alias("prompt_md"),
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(x.alias("text_md"))).alias("options"),
    )
    return search_export(records)


@query(
    "export_rows_all_terms",
    f"""WITH {B.QUESTION}, {B.CURRENT_MARK}, lines AS (SELECT id, exam_id, certification_id, domain_label, type,
      string_split(prompt_md, chr(10)) AS parts FROM question), rows_ AS (
    SELECT id, certification_id AS cert, domain_label AS domain, type,
      regexp_replace(lower(concat_ws(' ', parts[1], domain_label, id::VARCHAR, array_to_string(parts[2:], ' '))), '\\s+', ' ', 'g') AS search
    FROM lines)
    SELECT r.id, r.domain, r.type FROM rows_ r LEFT JOIN current_mark m ON m.question_id = r.id
    WHERE contains(search, 'the') AND contains(search, 'and') AND cert = 'en' AND coalesce(nullif(m.value, 'error'), '') = ''""",
)
def export_rows_all_terms(bank):
    marks = S.current_mark_lookup(bank.question.select(F.col("id").alias("question_id")), state.current_mark(bank.mark), B.CLEARED)
    rows = _export(bank).join(marks.select(F.col("question_id").alias("id"), F.col("value").alias("mark")), "id", "left")
    return S.all_terms_filter(rows, "the and", cert="en", mark="unmarked").select("id", "domain", "type")


@query(
    "keyed_lookup",
    f"""WITH {B.QUESTION} SELECT id, exam_id, type FROM question WHERE id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def keyed_lookup(bank):
    ids = bank.mark.where(F.col("value") == "purchase").select(F.col("question_id").alias("id"))
    return S.keyed_lookup(bank.question, ids).select("id", "exam_id", "type")


@query(
    "marks_for_listed_questions",
    f"""WITH {B.CURRENT_MARK} SELECT question_id, value FROM current_mark
    WHERE value <> 'error' AND question_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
)
def marks_for_listed_questions(bank):
    ids = bank.question.where(F.col("certification_id") == "en").select(F.col("id").alias("question_id"))
    return S.current_mark_lookup(ids, state.current_mark(bank.mark), B.CLEARED)


@query(
    "ranked_page",
    f"""WITH {B.QUESTION} SELECT id AS question_id, score FROM (
      SELECT id, -round(n_chars / 10.0, 1)::DOUBLE AS score FROM question WHERE certification_id = 'en')
    ORDER BY score, id LIMIT 20 OFFSET 40""",
)
def ranked_page(bank):
    scored = bank.question.where(F.col("certification_id") == "en").select(
        F.col("id").alias("question_id"), (-F.round(F.col("n_chars") / F.lit(10.0), 1)).alias("score")
    )
    return S.page(scored, 20, 40)


@query(
    "page_clamping",
    f"""WITH {B.QUESTION}, totals AS (SELECT exam_id, count(*) AS total, max(id) % 300 - 50 AS page_no, (min(id) % 150)::BIGINT AS per_page FROM question GROUP BY exam_id),
    s AS (SELECT *, greatest(1, least(coalesce(nullif(per_page, 0), 25), 100))::BIGINT AS size FROM totals),
    p AS (SELECT *, greatest(1, ceil(total::DOUBLE / size))::BIGINT AS pages FROM s),
    c AS (SELECT *, least(pages, greatest(1, page_no)) AS page FROM p)
    SELECT exam_id, total, size AS per_page, pages, page, CASE WHEN total = 0 THEN 0 ELSE (page - 1) * size + 1 END AS first_row,
      least(page * size, total) AS last_row, page > 1 AS has_previous, page < pages AS has_next FROM c""",
)
def page_clamping(bank):
    totals = bank.question.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("total"), (F.max("id") % 300 - 50).alias("page_no"), (F.min("id") % 150).alias("per_page")
    )
    return totals.select("exam_id", "total", S.clamp_page(F.col("total"), F.col("page_no"), F.col("per_page")).alias("p")).select(
        "exam_id", "total", "p.*"
    )


@query(
    "page_of_every_row",
    f"""WITH {B.QUESTION} SELECT id, exam_id, ceil(rn / 25.0)::BIGINT AS page FROM (
      SELECT id, exam_id, row_number() OVER (PARTITION BY exam_id ORDER BY id) AS rn FROM question)""",
)
def page_of_every_row(bank):
    from itemloom.functions import blocked

    ranked = blocked.row_number(
        bank.question.select("id", "exam_id"), ["exam_id"], F.floor(F.col("id") / 100000), [F.col("id")], "rn"
    )
    return ranked.select("id", "exam_id", F.ceil(F.col("rn") / S.DEFAULT_PER_PAGE).cast("bigint").alias("page"))
