"""Queries: corpus statistics and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import grading as g
from itemloom.functions import text as tx
from itemloom.operators import exams, projection as P, stats
from itemloom.plans import bindings as B
from itemloom.plans.registry import query

M = f"""WITH {B.RECORD}, sums AS (SELECT oid, sum(length(text_md)) AS oc, sum(length(coalesce(explanation_md, ''))) AS xc FROM options_of GROUP BY oid),
  m AS (SELECT f.*, f.cert AS certification_id, f.domain AS domain_label, length(prompt_md) AS pc, length(coalesce(overall_explanation_md, '')) AS ec, coalesce(oc, 0) AS oc, coalesce(xc, 0) AS xc, len(refs)::INT AS n_references
    FROM full_record f LEFT JOIN sums ON oid = f.id)"""
PROFILE = """count(*) AS questions, count(*) FILTER (type = 'single_select') AS single_select, count(*) FILTER (type = 'multi_select') AS multi_select,
  round_even(sum(pc) / count(*), 1) AS prompt_mean, round_even(coalesce(sum(oc) / nullif(sum(n_options), 0), 0.0), 1) AS option_mean, round_even(sum(ec) / count(*), 1) AS explanation_mean,
  round_even(coalesce(sum(xc) / nullif(sum(n_options), 0), 0.0), 1) AS option_explanation_mean, sum(pc + oc + ec + xc)::BIGINT AS total_chars"""
C = f"WITH {B.CITATION}"


def _m(bank):
    return stats.measured(bank.record)


def cited(bank):
    keys = bank.record.select(F.col("id"), F.col("certification.slug").alias("certification_id"), F.col("domain").alias("domain_label"), "references")
    return keys.select("*", F.posexplode("references").alias("position", "raw_url")).select(
        F.col("id").alias("question_id"), "certification_id", "domain_label", "position", "raw_url",
        tx.normalize_reference(F.col("raw_url"), B.MIRROR_DOCS, B.MIRROR_SUPPORT).alias("reference_id"),
    )


@query("domain_profiles", f"{M} SELECT certification_id, domain_label, {PROFILE} FROM m GROUP BY 1, 2")
def domain_profiles(bank):
    return stats.domain_profiles(_m(bank))


@query(
    "exam_profiles",
    f"{M} SELECT certification_id, exam_slug, first(exam_title ORDER BY n) AS exam_title, first(exam_mode ORDER BY n) AS exam_mode, {PROFILE} FROM m GROUP BY 1, 2",
)
def exam_profiles(bank):
    return stats.exam_profiles(_m(bank))


@query(
    "mode_profiles",
    f"{M} SELECT certification_id, coalesce(exam_mode, 'standard') AS mode, {PROFILE}, count(DISTINCT exam_slug) AS exams, round_even(count(*) FILTER (type = 'multi_select') / count(*) * 100, 1) AS multi_select_pct FROM m GROUP BY 1, 2",
)
def mode_profiles(bank):
    return stats.mode_profiles(_m(bank))


@query("length_profile", f"{M} SELECT {PROFILE} FROM m")
def length_profile(bank):
    return _m(bank).agg(*stats.profile_columns())


@query(
    "type_split",
    f"{M} SELECT count(*) FILTER (type = 'single_select') AS single_select, count(*) FILTER (type = 'multi_select') AS multi_select FROM m",
)
def type_split(bank):
    return bank.record.agg(
        F.count_if(F.col("type") == "single_select").alias("single_select"), F.count_if(F.col("type") == "multi_select").alias("multi_select")
    )


@query(
    "certification_summary",
    f"""{M} SELECT certification_id, count(*) AS questions, count(DISTINCT exam_slug) AS exams, count(DISTINCT domain_label) AS domains,
    count(*) FILTER (type = 'single_select') AS single_select, count(*) FILTER (type = 'multi_select') AS multi_select FROM m GROUP BY 1""",
)
def certification_summary(bank):
    return stats.certification_summary(_m(bank))


@query(
    "corpus_totals",
    f"""{M}, {B.CITATION.replace(B.RECORD + ', ', '', 1)} SELECT count(*) AS questions, count(DISTINCT cert) AS certifications, count(DISTINCT cert || '/' || coalesce(domain, '')) AS domains, count(DISTINCT cert || '/' || coalesce(exam_slug, '')) AS exams,
    sum(n_options)::BIGINT AS options, sum(pc + oc + ec + xc)::BIGINT AS corpus_chars, (SELECT count(DISTINCT reference_id) FROM citation) AS "references", (SELECT count(*) FROM citation) AS reference_citations FROM m""",
)
def corpus_totals(bank):
    return stats.totals(_m(bank), cited(bank))


@query("coverage_cells", f"{M} SELECT certification_id, domain_label, exam_slug, count(*) AS n FROM m GROUP BY 1, 2, 3")
def coverage_cells(bank):
    return stats.coverage_cells(_m(bank))


@query(
    "coverage_matrix",
    f"""{M}, d AS (SELECT DISTINCT certification_id, domain_label FROM m WHERE domain_label IS NOT NULL AND exam_slug IS NOT NULL), e AS (SELECT DISTINCT certification_id, exam_slug FROM m WHERE exam_slug IS NOT NULL AND domain_label IS NOT NULL),
    c AS (SELECT certification_id, domain_label, exam_slug, count(*) AS n FROM m GROUP BY 1, 2, 3)
    SELECT d.certification_id, d.domain_label, string_agg(e.exam_slug, ',' ORDER BY e.exam_slug) AS exams, string_agg(coalesce(c.n, 0)::VARCHAR, ',' ORDER BY e.exam_slug) AS counts
    FROM d JOIN e ON e.certification_id = d.certification_id LEFT JOIN c ON c.certification_id = d.certification_id AND c.domain_label = d.domain_label AND c.exam_slug = e.exam_slug GROUP BY 1, 2""",
)
def coverage_matrix(bank):
    grid = stats.coverage_matrix(_m(bank))
    return grid.select("certification_id", "domain_label", F.array_join("exams", ",").alias("exams"), F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(
    "answer_positions",
    f"""WITH {B.GRADED_ITEM}, x AS (SELECT unnest(correct_labels) AS label FROM graded_item), t AS (SELECT count(*) AS total FROM x),
    c AS (SELECT v.label, count(x.label) AS "count" FROM (VALUES ('A'), ('B'), ('C'), ('D')) v(label) LEFT JOIN x ON x.label = v.label GROUP BY 1)
    SELECT label, "count", round_even(total / 4, 1) AS expected, "count" - total / 4 AS deviation, round_even(("count" - total / 4) * 100 / (total / 4), 1) AS deviation_pct FROM c, t""",
)
def answer_positions(bank):
    return stats.answer_positions(bank.graded_item)


def _histogram_sql(source: str, edges) -> str:
    bounds = list(zip(edges, [*edges[1:], None]))
    bins = ", ".join(
        f"('{lo}+', {lo}, NULL::INT)" if hi is None else f"('{lo}-{hi - 1}', {lo}, {hi})" for lo, hi in bounds
    )
    return (
        f"v AS ({source}) SELECT b.label, b.low::INT AS low, b.high::INT AS high, count(v.x) AS \"count\" FROM (VALUES {bins}) b(label, low, high) "
        "LEFT JOIN v ON v.x >= b.low AND (b.high IS NULL OR v.x < b.high) GROUP BY 1, 2, 3"
    )


@query("prompt_histogram", f"WITH {_histogram_sql('SELECT n_chars AS x FROM documents', stats.LENGTH_BINS['prompt'])}")
def prompt_histogram(bank):
    return stats.histogram(bank.table("documents"), "n_chars", stats.LENGTH_BINS["prompt"])


@query("option_histogram", f"{M}, {_histogram_sql('SELECT length(text_md) AS x FROM options_of', stats.LENGTH_BINS['option'])}")
def option_histogram(bank):
    lengths = bank.record.select(F.explode("options.text_md").alias("t")).select(F.length("t").alias("chars"))
    return stats.histogram(lengths, "chars", stats.LENGTH_BINS["option"])


@query("explanation_histogram", f"WITH {_histogram_sql('SELECT length(html) AS x FROM pages', stats.LENGTH_BINS['explanation'])}")
def explanation_histogram(bank):
    return stats.histogram(bank.table("pages").select(F.length("html").alias("chars")), "chars", stats.LENGTH_BINS["explanation"])


def _section(x: str) -> str:
    s = f"string_split({x}, '/')"
    words = f"list_filter(string_split(replace({s}[2], '-', ' '), ' '), lambda w: w <> '')"
    title = "list_aggregate(list_transform(regexp_extract_all(w, '\\p{L}+|[^\\p{L}]+'), lambda r: replace(upper(left(r, 1)), 'ẞ', 'Ss') || lower(r[2:])), 'string_agg', '')"
    pretty = f"array_to_string(list_transform({words}, lambda w: CASE WHEN w IN ('api', 'sdk', 'mcp') THEN upper(w) ELSE {title} END), ' ')"
    return f"CASE WHEN {s}[1] = 'support' THEN 'Support articles' WHEN {s}[1] = 'docs' AND len({s}) < 2 THEN 'Docs' WHEN {s}[1] = 'docs' THEN {pretty} ELSE {s}[1] END"


_INDEX = f"""idx AS (SELECT reference_id AS key, arg_min(raw_url, row(length(raw_url), raw_url)) AS url, count(*) AS citations, count(DISTINCT raw_url) AS variants,
    count(DISTINCT cert) AS certifications, count(DISTINCT cert || '/' || coalesce(domain, '')) AS domains, {_section('reference_id')} AS section FROM citation GROUP BY reference_id)"""


@query("citation_index", f"{C}, {_INDEX} SELECT * FROM idx")
def citation_index(bank):
    return stats.citation_index(cited(bank))


@query(
    "citation_index_raw_urls",
    f"""{C} SELECT raw_url AS key, count(*) AS citations, count(DISTINCT cert) AS certifications, count(DISTINCT cert || '/' || coalesce(domain, '')) AS domains FROM citation GROUP BY 1""",
)
def citation_index_raw_urls(bank):
    rows = cited(bank).withColumn("k", F.col("raw_url"))
    return stats.citation_index(rows, "k").select("key", "citations", "certifications", "domains")


@query("citation_members", f"{C} SELECT reference_id AS key, question_id, count(*) AS times FROM citation GROUP BY 1, 2")
def citation_members(bank):
    return stats.citation_members(cited(bank))


@query("reference_sections", f"{C}, {_INDEX} SELECT section, count(*) AS pages, sum(citations)::BIGINT AS citations FROM idx GROUP BY 1")
def reference_sections(bank):
    return stats.reference_sections(stats.citation_index(cited(bank)))


@query("reference_density", f'{M} SELECT n_references AS "references", count(*) AS questions FROM m GROUP BY 1')
def reference_density(bank):
    return stats.reference_density(_m(bank))


@query(
    "top_domain_references",
    f"""{C}, k AS (SELECT cert AS certification_id, domain AS domain_label, reference_id, count(*) AS n FROM citation GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY certification_id, domain_label ORDER BY n DESC, reference_id)::INT AS rank FROM k QUALIFY rank <= 5""",
)
def top_domain_references(bank):
    return stats.top_domain_references(cited(bank))


@query(
    "top_references",
    f"{C} SELECT reference_id AS id, min(raw_url) AS display_url, count(DISTINCT question_id) AS question_count FROM citation GROUP BY 1 ORDER BY question_count DESC, id LIMIT 10",
)
def top_references(bank):
    return stats.top_references(P.reference_rows(cited(bank))).select("id", "display_url", "question_count")


_STOP = ["the", "and", "with", "for", "les", "des", "que", "der", "die", "und"]
_TOKENS = """tok AS (SELECT lang || ' / ' || source AS domain, unnest(list_filter(list_transform(regexp_extract_all(regexp_replace(lower(text), '\\\\(.)', '\\1', 'g'), '[a-z][a-z0-9_.\\-]{2,}'), lambda w: rtrim(w, '.-_')), lambda w: length(w) > 2 AND w NOT IN (%s))) AS term FROM documents),
    counts AS (SELECT domain, term, count(*) AS n FROM tok GROUP BY ALL)""" % ", ".join(f"'{w}'" for w in _STOP)


def _term_counts(bank):
    return stats.domain_tokens(bank.table("documents"), F.concat_ws(" / ", "lang", "source"), F.col("text"), _STOP)


@query("domain_term_counts", f"WITH {_TOKENS} SELECT domain, term, n FROM counts")
def domain_term_counts(bank):
    return _term_counts(bank)


@query(
    "distinctive_terms",
    f"""WITH {_TOKENS}, v AS (SELECT DISTINCT term FROM counts),
    folded AS (SELECT domain, coalesce(v.term, c.term) AS term, sum(n)::BIGINT AS n FROM counts c LEFT JOIN v ON c.term LIKE '%s' AND v.term = left(c.term, length(c.term) - 1) GROUP BY 1, 2),
    spread AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, (SELECT count(DISTINCT lang || ' / ' || source) FROM documents) AS d FROM folded),
    scored AS (SELECT *, n * ln(d / df) AS s FROM spread WHERE n >= 3 AND df < d)
    SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY s DESC, term)::INT AS rank, term, round(s, 3) AS score, n AS "count" FROM scored QUALIFY rank <= 12""",
)
def distinctive_terms(bank):
    domains = bank.table("documents").select(F.concat(F.col("lang"), F.lit(" / "), F.col("source")).alias("domain"))
    return stats.distinctive_terms(_term_counts(bank), domains=domains)


@query(
    "table_counts",
    f"""{C} SELECT 'certification' AS table_name, count(DISTINCT cert) AS n FROM record UNION ALL SELECT 'question', count(*) FROM record UNION ALL SELECT 'option', count(*) FROM options_of
    UNION ALL SELECT 'reference', count(DISTINCT reference_id) FROM citation UNION ALL SELECT 'citation', count(*) FROM (SELECT DISTINCT question_id, reference_id FROM citation)
    UNION ALL SELECT 'exam', count(DISTINCT cert || '/' || exam_slug) FROM record UNION ALL SELECT 'domain', count(DISTINCT cert || '/' || domain) FROM record""",
)
def table_counts(bank):
    r, c = bank.record, cited(bank)
    return stats.table_counts(
        {
            "certification": P.certification_rows(r),
            "exam": P.exam_rows(r),
            "domain": P.domain_rows(r),
            "question": r,
            "option": P.option_rows(r),
            "reference": P.reference_rows(c),
            "citation": P.question_reference_rows(c),
        }
    )


@query("counts_by_domain", f"{M} SELECT certification_id, domain_label, count(*) AS n FROM m GROUP BY 1, 2")
def counts_by_domain(bank):
    return stats.group_counts(_m(bank), "certification_id", "domain_label")


@query("counts_by_certification", f"WITH {B.QUESTION} SELECT certification_id, count(*) AS n FROM question GROUP BY 1")
def counts_by_certification(bank):
    return stats.group_counts(bank.question, "certification_id")


@query("counts_by_exam", f"{M} SELECT exam_slug, count(*) AS n FROM m WHERE exam_slug IS NOT NULL GROUP BY 1")
def counts_by_exam(bank):
    return stats.group_counts(_m(bank), "exam_slug", drop_null=True)


@query("counts_by_origin", f"WITH {B.QUESTION} SELECT origin, count(*) AS n FROM question GROUP BY 1")
def counts_by_origin(bank):
    return stats.group_counts(bank.question, "origin")


@query(
    "certification_question_counts",
    "SELECT n_name AS certification_id, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)
def certification_question_counts(bank):
    rich = bank.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return bank.table("nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("certification_id"), F.coalesce("k", F.lit(0).cast("bigint")).alias("n")
    )


@query("expected_field_count", f"{M} SELECT sum(2 + 2 * n_options)::BIGINT AS fields FROM m")
def expected_field_count(bank):
    return stats.expected_fields(bank.record)


@query(
    "declared_counts",
    f"""{M}, i AS (SELECT lang AS provider, count(*) AS declared FROM documents WHERE n_chars > 100 GROUP BY 1), l AS (SELECT provider, count(*) AS loaded FROM m GROUP BY 1)
    SELECT coalesce(i.provider, l.provider) AS provider, coalesce(declared, 0) AS declared, coalesce(loaded, 0) AS loaded, declared IS NOT DISTINCT FROM loaded AS agrees FROM i FULL JOIN l ON l.provider = i.provider""",
)
def declared_counts(bank):
    index = bank.table("documents").where(F.col("n_chars") > 100).groupBy(F.col("lang").alias("provider")).agg(F.count(F.lit(1)).alias("line_count"))
    return stats.declared_counts(index, bank.record)


# ---------------------------------------------------------------- grading

_COMB = "CASE WHEN {k} > {n} THEN 0 ELSE (factorial({n}::INT) / (factorial({k}::INT) * factorial(({n} - {k})::INT)))::BIGINT END"
_GRADED = f"""{B.GRADED_ITEM}, sized AS (SELECT *, list_filter(option_labels, lambda x: list_contains(correct_labels, x)) AS key, list_filter(option_labels, lambda x: list_contains(selected_labels, x)) AS chosen FROM graded_item),
    w AS (SELECT *, len(key) AS wanted, greatest({_COMB.format(n='len(option_labels)', k='len(key)')} - 1, 0) AS ways FROM sized),
    graded AS (SELECT * EXCLUDE (credit, is_correct), len(chosen) > 0 AND chosen = key AS is_correct,
      CASE WHEN len(chosen) = 0 THEN 'blank' WHEN chosen = key THEN 'correct' WHEN len(chosen) > wanted THEN 'over_selected' WHEN len(chosen) < wanted THEN 'under_selected' ELSE 'incorrect' END AS outcome,
      CASE WHEN len(chosen) = 0 THEN 0.0::DOUBLE WHEN chosen = key THEN 1.0::DOUBLE WHEN ways > 0 THEN -1.0::DOUBLE / ways ELSE 0.0::DOUBLE END AS credit FROM w)"""


@query(
    "graded_items",
    f"WITH {_GRADED} SELECT id, array_to_string(key, '') AS key, array_to_string(chosen, '') AS chosen, is_correct, outcome, ways, round(credit, 6) AS credit FROM graded",
)
def graded_items(bank):
    return exams.grade_items(bank.graded_item).select(
        "id", F.array_join("key", "").alias("key"), F.array_join("chosen", "").alias("chosen"), "is_correct", "outcome", "ways", F.round("credit", 6).alias("credit")
    )


@query("grade_outcomes", f"WITH {_GRADED} SELECT outcome, count(*) AS n FROM graded GROUP BY 1")
def grade_outcomes(bank):
    return exams.grade_items(bank.graded_item).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ungradable_items",
    f"WITH {B.GRADED_ITEM} SELECT id, 'no correct answer' AS problem FROM graded_item WHERE NOT list_has_any(correct_labels, option_labels[2:])",
)
def ungradable_items(bank):
    cut = bank.graded_item.withColumn("option_labels", F.slice("option_labels", F.lit(2), F.lit(9)))
    return exams.ungradable_items(cut).select("id", "problem")


def _attempts_sql(scale: str, cut: str, extra: str = "", where: str = "") -> str:
    return f"""WITH {B.ATTEMPT}, {_GRADED}, t AS (SELECT attempt_id, count(*) AS item_count, count(answered_at) AS answered_count, count(*) FILTER (is_correct) AS correct_count, sum(credit) AS credit_total FROM graded GROUP BY 1),
    s AS (SELECT a.id AS attempt_id, certification_id, coalesce(item_count, 0) AS item_count, coalesce(answered_count, 0) AS answered_count, coalesce(correct_count, 0) AS correct_count, coalesce(credit_total, 0.0) AS credit_total,
      round_even({scale}, 0)::INT AS scaled_score, {cut} AS cut FROM attempt a LEFT JOIN t ON t.attempt_id = a.id {extra} WHERE submitted_at IS NOT NULL {where})
    SELECT attempt_id, certification_id, item_count, answered_count, correct_count, round(credit_total, 6) AS credit_total, scaled_score, scaled_score >= cut AS passed FROM s"""


@query("graded_attempts", _attempts_sql("100 + coalesce(correct_count / item_count, 0.0) * 900", "720"))
def graded_attempts(bank):
    return exams.grade_attempts(bank.attempt, bank.graded_item).withColumn("credit_total", F.round("credit_total", 6))


@query(
    "graded_attempts_with_profiles",
    _attempts_sql(
        "coalesce(p.lo, 100) + coalesce(correct_count / item_count, 0.0) * (coalesce(p.hi, 1000) - coalesce(p.lo, 100))",
        "coalesce(p.cut, 720)",
        "LEFT JOIN (SELECT p_container AS c, lo, hi, cut FROM (SELECT o_orderpriority AS p_container, 0 AS lo, 200 AS hi, (max(o_custkey) % 100)::INT AS cut FROM orders WHERE o_orderpriority < '3' GROUP BY 1)) p ON p.c = certification_id",
        "AND a.id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)",
    ),
)
def graded_attempts_with_profiles(bank):
    scale = bank.table("orders").where(F.col("o_orderpriority") < "3").groupBy(F.col("o_orderpriority").alias("certification_id")).agg(
        F.lit(0).alias("scale_min"), F.lit(200).alias("scale_max"), (F.max("o_custkey") % 100).cast("int").alias("cut_score")
    )
    done = bank.table("lineitem").where(F.col("l_quantity") > 48).select(F.col("l_orderkey").alias("attempt_id"))
    return exams.grade_attempts(bank.attempt, bank.graded_item, scale, done).withColumn("credit_total", F.round("credit_total", 6))


@query(
    "cut_proportions",
    """WITH s AS (SELECT o_custkey AS id, 100 AS lo, (100 + 150 * (count(*) % 4))::INT AS hi, (max(o_orderkey) % 100)::INT + 100 AS cut FROM orders GROUP BY 1)
    SELECT id, CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE round((cut - lo)::DOUBLE / (hi - lo), 9) END AS cut_proportion FROM s""",
)
def cut_proportions(bank):
    n = F.count(F.lit(1))
    scales = bank.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.lit(100).alias("lo"), (n % 4 * 150 + 100).cast("int").alias("hi"), (F.max("o_orderkey") % 100 + 100).cast("int").alias("cut")
    )
    return scales.select("id", F.round(g.cut_proportion(F.col("lo"), F.col("hi"), F.col("cut")), 9).alias("cut_proportion"))


@query(
    "domain_results",
    f"""WITH {B.GRADED_ITEM}, d AS (SELECT attempt_id, coalesce(CASE WHEN qty > 45 THEN NULL ELSE p_brand END, 'unspecified') AS label, count(*) AS asked, count(*) FILTER (is_correct) AS correct FROM graded_item GROUP BY 1, 2)
    SELECT *, round(100.0 * correct / asked, 6) AS percent, correct || ' of ' || asked AS share,
      (row_number() OVER (PARTITION BY attempt_id ORDER BY CASE WHEN asked = 0 THEN 0 ELSE correct * 100.0::DOUBLE / asked END, label))::INT AS worst_rank FROM d""",
)
def domain_results(bank):
    rows = bank.graded_item.withColumn("domain_label", F.when(F.col("qty") <= 45, F.col("p_brand")))
    return exams.domain_results(rows).withColumn("percent", F.round("percent", 6))


@query(
    "guessing_calibration",
    f"""WITH {_GRADED}, shapes AS (SELECT len(option_labels) AS o, wanted, arg_min(option_labels, array_to_string(key, '')) AS labels, min(array_to_string(key, '')) AS key FROM graded GROUP BY 1, 2),
    masks AS (SELECT *, unnest(range(0, (1 << o)::BIGINT)) AS mask FROM shapes), guesses AS (SELECT o, wanted, key, array_to_string(list_filter(labels, lambda x, i: (mask >> (i - 1)::BIGINT) & 1 = 1), '') AS chosen FROM masks WHERE bit_count(mask) = wanted),
    credited AS (SELECT *, CASE WHEN chosen = key THEN 1.0::DOUBLE ELSE -1.0::DOUBLE / (count(*) OVER (PARTITION BY o, wanted) - 1) END AS credit FROM guesses)
    SELECT o::INT AS options, wanted::INT AS wanted, count(*) AS responses, round(avg(credit), 9) + 0.0::DOUBLE AS expected_credit FROM credited GROUP BY 1, 2""",
)
def guessing_calibration(bank):
    return exams.guessing_calibration(exams.grade_items(bank.graded_item))


@query(
    "response_combinations",
    """SELECT p_partkey, (p_size % 12)::INT AS k, (factorial(20) / (factorial((p_size % 12)::INT) * factorial((20 - p_size % 12)::INT)))::BIGINT AS ways FROM part""",
)
def response_combinations(bank):
    k = (F.col("p_size") % 12).cast("int")
    return bank.table("part").select("p_partkey", k.alias("k"), g.combinations(F.lit(20), k).alias("ways"))
