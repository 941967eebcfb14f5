"""Queries: outline text, page extraction, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom.functions import text as tx
from itemloom.operators import outline as O
from itemloom.plans import bindings as B
from itemloom.plans.registry import query
from itemloom.sources import outlines, pages

# One outline file per nation: headers, then up to three lines per customer.
_LINES = """line AS (
  SELECT 'n' || n_nationkey AS file, l.no AS line_no, l.raw FROM nation, (SELECT 1 AS no, 'certification: ' AS raw) l WHERE FALSE
  UNION ALL SELECT 'n' || n_nationkey, 1, '# outline of ' || n_name FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 2, 'certification: ' || n_name FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 3, CASE WHEN n_regionkey = 4 THEN 'levels: Domain, Task, Topic' ELSE 'levels: Domain, Task' END FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 4, CASE n_regionkey WHEN 3 THEN 'vendor ' ELSE 'vendor: v' END || n_regionkey FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 5, 'regime: ' || CASE n_regionkey WHEN 0 THEN 'exact' WHEN 1 THEN 'range' WHEN 2 THEN 'absent' WHEN 3 THEN 'odd' ELSE 'exact' END FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 6, 'source: guides/' || n_name || '.pdf sha256=' || CASE WHEN n_nationkey % 4 = 0 THEN 'abc' ELSE sha256(n_name) END || ' kind=pdf retrieved=2024-01-0' || (n_regionkey + 1) || ' note=see page ' || n_nationkey || ' of it' FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 7, CASE WHEN n_nationkey % 6 = 0 THEN 'regime: exact' ELSE '' END FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 10 * (c_custkey + 1), CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE '' END || '- [' || CASE WHEN c_custkey % 37 = 0 THEN 'many' WHEN c_custkey % 5 = 0 THEN (c_custkey % 30) || '-' || (c_custkey % 23 + 5) || '%' ELSE (c_custkey % 50) || '%' END || '] ' || c_name FROM customer
  UNION ALL SELECT 'n' || c_nationkey, 10 * (c_custkey + 1) + 1, CASE WHEN c_custkey % 29 = 0 THEN '  - [5%] ' ELSE '  - ' END || c_mktsegment FROM customer
  UNION ALL SELECT 'n' || c_nationkey, 10 * (c_custkey + 1) + 2, CASE WHEN c_custkey % 31 = 0 THEN '      - ' ELSE '    - ' END || 'topic ' || c_custkey FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT 'n' || c_nationkey, 10 * (c_custkey + 1) + d, repeat(' ', 2 * d + 2) || '- detail ' || d FROM customer, range(3, 5) r(d) WHERE c_custkey % 43 = 0),
  kept AS (SELECT * FROM line WHERE trim(raw) <> '' AND NOT starts_with(ltrim(raw), '#')),
  cls AS (SELECT file, line_no::BIGINT AS line_no, raw, CASE WHEN regexp_matches(raw, '^ *- ') THEN 'bullet' WHEN regexp_matches(raw, '^[a-z_]+:') THEN 'header' ELSE 'other' END AS kind,
    length(regexp_extract(raw, '^( *)- ', 1))::INT AS spaces, nullif(regexp_extract(raw, '^ *- \\[([^\\]]+)\\]', 1), '') AS weight_text, regexp_extract(raw, '^ *- (?:\\[[^\\]]+\\]\\s*)?(.*)$', 1) AS label,
    regexp_extract(raw, '^([a-z_]+):', 1) AS key, rtrim(regexp_extract(raw, '^[a-z_]+:[ ]?(.*)$', 1)) AS value FROM kept),
  bul AS (SELECT *, (spaces // 2 + 1)::INT AS depth, TRY_CAST(regexp_extract(weight_text, '^\\s*(\\d+(?:\\.\\d+)?)\\s*%?\\s*$', 1) AS DOUBLE) AS weight_pct,
    TRY_CAST(regexp_extract(weight_text, '^\\s*(\\d+(?:\\.\\d+)?)\\s*[-–]\\s*(\\d+(?:\\.\\d+)?)\\s*%?\\s*$', 1) AS DOUBLE) AS weight_min, TRY_CAST(regexp_extract(weight_text, '^\\s*(\\d+(?:\\.\\d+)?)\\s*[-–]\\s*(\\d+(?:\\.\\d+)?)\\s*%?\\s*$', 2) AS DOUBLE) AS weight_max FROM cls WHERE kind = 'bullet')"""


def _lines(bank):
    nation = bank.table("nation")
    file, region = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_regionkey")
    name, key = F.col("n_name"), F.col("n_nationkey")
    regime = F.when(region == 0, "exact").when(region == 1, "range").when(region == 2, "absent").when(region == 3, "odd").otherwise("exact")
    digest = F.when(key % 4 == 0, "abc").otherwise(F.sha2("n_name", 256))
    heads = [
        (1, F.concat(F.lit("# outline of "), name)),
        (2, F.concat(F.lit("certification: "), name)),
        (3, F.when(region == 4, "levels: Domain, Task, Topic").otherwise("levels: Domain, Task")),
        (4, F.concat(F.when(region == 3, "vendor ").otherwise("vendor: v"), region.cast("string"))),
        (5, F.concat(F.lit("regime: "), regime)),
        (6, F.concat(F.lit("source: guides/"), name, F.lit(".pdf sha256="), digest, F.lit(" kind=pdf retrieved=2024-01-0"), (region + 1).cast("string"), F.lit(" note=see page "), key.cast("string"), F.lit(" of it"))),
        (7, F.when(key % 6 == 0, "regime: exact").otherwise("")),
    ]
    top = nation.select(file.alias("file"), F.explode(F.array(*[F.struct(F.lit(n).cast("bigint").alias("line_no"), raw.alias("raw")) for n, raw in heads])).alias("l")).select("file", "l.*")
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    weight = F.when(k % 37 == 0, "many").when(k % 5 == 0, F.concat(s(k % 30), F.lit("-"), s(k % 23 + 5), F.lit("%"))).otherwise(F.concat(s(k % 50), F.lit("%")))
    base = (k + 1) * 10
    bullets = F.array_compact(
        F.array(
            F.struct(base.alias("line_no"), F.concat(F.when(k % 41 == 0, " ").otherwise(""), F.lit("- ["), weight, F.lit("] "), "c_name").alias("raw")),
            F.struct((base + 1).alias("line_no"), F.concat(F.when(k % 29 == 0, "  - [5%] ").otherwise("  - "), "c_mktsegment").alias("raw")),
            F.when(F.col("c_acctbal") > 5000, F.struct((base + 2).alias("line_no"), F.concat(F.when(k % 31 == 0, "      - ").otherwise("    - "), F.lit("topic "), s(k)).alias("raw"))),
            *[F.when(k % 43 == 0, F.struct((base + d).alias("line_no"), F.lit(" " * (2 * d + 2) + f"- detail {d}").alias("raw"))) for d in (3, 4)],
        )
    )
    body = bank.table("customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"), F.explode(bullets).alias("l")).select("file", "l.*")
    return top.unionByName(body)


def _classified(bank):
    return outlines.classify_lines(_lines(bank))


@query("outline_lines", f"WITH {_LINES} SELECT file, line_no, kind, CASE WHEN kind = 'bullet' THEN label END AS label, CASE WHEN kind = 'header' THEN key END AS key, CASE WHEN kind = 'header' THEN value END AS value FROM cls")
def outline_lines(bank):
    return _classified(bank).select("file", "line_no", "kind", "label", "key", "value")


_FLAT = f"""{_LINES}, par AS (SELECT *, (SELECT max(b.line_no) FROM bul b WHERE b.file = a.file AND b.line_no < a.line_no AND b.depth < a.depth) AS parent FROM bul a),
  num AS (SELECT *, row_number() OVER (PARTITION BY file, parent ORDER BY line_no) AS ordinal FROM par),
  tree AS (SELECT file, line_no, ordinal::VARCHAR AS path, NULL::VARCHAR AS parent_path FROM num WHERE parent IS NULL
    UNION ALL SELECT n.file, n.line_no, t.path || '.' || n.ordinal, t.path FROM num n JOIN tree t ON t.file = n.file AND t.line_no = n.parent),
  flat AS (SELECT n.file, n.line_no, depth, ordinal, path, parent_path, label, weight_pct, weight_min, weight_max FROM num n JOIN tree t ON t.file = n.file AND t.line_no = n.line_no)"""


@query("outline_nodes", f"WITH RECURSIVE {_FLAT} SELECT * FROM flat")
def outline_nodes(bank):
    return O.flatten(_classified(bank))


@query(
    "outline_node_kinds",
    f"""WITH RECURSIVE {_FLAT}, lv AS (SELECT file, list_transform(string_split(value, ','), lambda x: trim(x)) AS levels FROM cls WHERE kind = 'header' AND key = 'levels')
    SELECT f.file, path, levels[depth] AS kind FROM flat f LEFT JOIN lv ON lv.file = f.file""",
)
def outline_node_kinds(bank):
    c = _classified(bank)
    return O.with_kinds(O.flatten(c), c).select("file", "path", "kind")


@query(
    "outline_weight_sums",
    f"""WITH RECURSIVE {_FLAT}, r AS (SELECT file, arg_min(value, line_no) AS regime FROM cls WHERE kind = 'header' AND key = 'regime' GROUP BY 1),
    t AS (SELECT file, sum(coalesce(weight_pct, 0)) AS e, sum(coalesce(weight_min, 0)) AS lo, sum(coalesce(weight_max, 0)) AS hi FROM flat WHERE depth = 1 GROUP BY 1)
    SELECT r.file, regime, CASE regime WHEN 'exact' THEN e WHEN 'range' THEN lo END AS weights_sum, CASE regime WHEN 'range' THEN hi END AS weights_sum_max, CASE regime WHEN 'exact' THEN abs(e - 100) < 1e-6 END AS weights_sum_to_100 FROM r JOIN t ON t.file = r.file""",
)
def outline_weight_sums(bank):
    c = _classified(bank)
    return O.weight_summary(O.flatten(c), O.regimes(c))


@query(
    "outline_sources",
    f"""WITH {_LINES} SELECT file, line_no, regexp_extract(value, '^(\\S+)', 1) AS path, regexp_extract(value, 'sha256=(\\S*)', 1) AS sha256, 'pdf' AS kind, regexp_extract(value, 'retrieved=(\\S*)', 1) AS retrieved_on, trim(split_part(value, 'note=', 2)) AS note FROM cls WHERE kind = 'header' AND key = 'source'""",
)
def outline_sources(bank):
    return outlines.sources(_classified(bank))


@query(
    "outline_problems",
    f"""WITH {_LINES}, st AS (SELECT *, lag(depth) OVER (PARTITION BY file ORDER BY line_no) AS before FROM bul), r AS (SELECT file, arg_min(value, line_no) AS regime FROM cls WHERE kind = 'header' AND key = 'regime' GROUP BY 1),
    top AS (SELECT b.*, regime, weight_pct IS NOT NULL AS ex, weight_min IS NOT NULL AS ra FROM bul b JOIN r ON r.file = b.file WHERE depth = 1),
    fb AS (SELECT file, min(line_no) AS fb FROM bul GROUP BY 1), hd AS (SELECT c.*, coalesce(line_no > fb, FALSE) AS late FROM cls c LEFT JOIN fb ON fb.file = c.file WHERE kind <> 'bullet'),
    fa AS (SELECT file, bool_or(kind = 'header' AND key = 'vendor') AS hv, max(CASE WHEN kind = 'header' AND key = 'regime' THEN value END) AS regime, max(CASE WHEN kind = 'header' AND key = 'levels' THEN len(string_split(value, ',')) END) AS levels, max(CASE WHEN kind = 'bullet' THEN spaces // 2 + 1 END) AS deepest FROM cls GROUP BY 1)
    SELECT file, line_no, 'indent is not a multiple of 2' AS problem FROM st WHERE spaces % 2 <> 0 UNION ALL SELECT file, line_no, 'deeper than 4' FROM st WHERE depth > 4 UNION ALL SELECT file, line_no, 'no parent' FROM st WHERE depth > coalesce(before, 0) + 1
    UNION ALL SELECT file, line_no, 'no label' FROM st WHERE trim(label) = '' UNION ALL SELECT file, line_no, 'weight below the top level' FROM st WHERE weight_text IS NOT NULL AND depth > 1
    UNION ALL SELECT file, line_no, 'not a weight' FROM st WHERE weight_text IS NOT NULL AND weight_pct IS NULL AND weight_min IS NULL UNION ALL SELECT file, line_no, 'range runs backwards' FROM st WHERE weight_min > weight_max
    UNION ALL SELECT file, line_no, 'weight missing for the regime' FROM top WHERE regime IN ('exact', 'range') AND NOT ex AND NOT ra
    UNION ALL SELECT file, line_no, 'weight of the wrong shape' FROM top WHERE (regime = 'exact' AND ra) OR (regime = 'range' AND ex) UNION ALL SELECT file, line_no, 'regime carries no weights' FROM top WHERE regime NOT IN ('exact', 'range') AND (ex OR ra)
    UNION ALL SELECT file, line_no, 'expected a bullet' FROM hd WHERE late UNION ALL SELECT file, line_no, 'expected a header or bullet' FROM hd WHERE NOT late AND kind = 'other'
    UNION ALL SELECT file, line_no, 'source needs sha256' FROM hd WHERE NOT late AND key = 'source' AND NOT regexp_matches(regexp_extract(value, 'sha256=(\\S*)', 1), '^[0-9a-f]{{64}}$')
    UNION ALL SELECT file, max(line_no), 'set twice: ' || key FROM cls WHERE kind = 'header' AND key <> 'source' GROUP BY file, key HAVING count(*) > 1
    UNION ALL SELECT file, 1, 'missing header: vendor' FROM fa WHERE NOT hv UNION ALL SELECT file, 1, 'unknown regime' FROM fa WHERE regime NOT IN ('exact', 'range', 'absent', 'unpublished') UNION ALL SELECT file, 1, 'too few level names' FROM fa WHERE levels < deepest
    UNION ALL SELECT file, 1, 'no nodes' FROM fa WHERE deepest IS NULL""",
)
def outline_problems(bank):
    return O.outline_problems(_classified(bank))


@query(
    "outline_refused",
    f"""WITH {_LINES}, st AS (SELECT *, lag(depth) OVER (PARTITION BY file ORDER BY line_no) AS before FROM bul)
    SELECT file, line_no, depth, label, unnest(list_filter([CASE WHEN spaces % 2 <> 0 THEN 'indent is not a multiple of 2' END, CASE WHEN depth > 4 THEN 'deeper than 4' END,
      CASE WHEN depth > coalesce(before, 0) + 1 THEN 'no parent' END], lambda x: x IS NOT NULL)) AS problem FROM st""",
)
def outline_refused(bank):
    return O.refused_lines(_classified(bank))


@query(
    "outline_source_drift",
    f"""WITH {_LINES}, s AS (SELECT file, regexp_extract(value, '^(\\S+)', 1) AS path, regexp_extract(value, 'sha256=(\\S*)', 1) AS sha256 FROM cls WHERE kind = 'header' AND key = 'source')
    SELECT file, path FROM s JOIN (SELECT 'guides/' || n_name || '.pdf' AS p, sha256(n_name) AS d FROM nation WHERE n_regionkey <> 2) f ON f.p = s.path WHERE d <> sha256""",
)
def outline_source_drift(bank):
    present = bank.table("nation").where(F.col("n_regionkey") != 2).select(F.concat(F.lit("guides/"), "n_name", F.lit(".pdf")).alias("path"), F.sha2("n_name", 256).alias("sha256"))
    return O.source_drift(outlines.sources(_classified(bank)).select("file", "path", "sha256"), present).select("file", "path")


# -------------------------------------------------------------------- pages


def extracted(bank):
    return pages.extract_pages(bank.table("pages"))


@query("page_extraction")
def page_extraction(bank):
    e = extracted(bank)
    return e.select("page_id", "url", "ok", "problem", "title", F.length("body_md").alias("chars"), F.size("links").alias("links"))


@query("page_quarantine_counts", "SELECT page_id % 10 AS batch, count(*) AS pages, count(*) FILTER (len(regexp_extract_all(html, '<article>')) <> 1) AS quarantined FROM pages GROUP BY 1")
def page_quarantine_counts(bank):
    return extracted(bank).groupBy((F.col("page_id") % 10).alias("batch")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("ok")).alias("quarantined"))


@query("page_lossless_check")
def page_lossless_check(bank):
    rows = extracted(bank).withColumn("host", tx.url_host(F.col("url")))
    return pages.lossless_check(rows, tx.strip_markdown(F.col("body_md")), "host")


@query(
    "exam_title_fields",
    """WITH t AS (SELECT o_orderkey, 'C' || upper(left(replace(o_orderpriority, '-', ''), 0)) || 'ERT-' || o_orderstatus || ' Full Practice Exam ' || (o_custkey % 130) || CASE WHEN o_orderkey % 3 = 0 THEN ': Hard Mode' ELSE '' END || ' - Results' AS raw FROM orders),
    c AS (SELECT *, trim(regexp_replace(raw, '\\s*-\\s*Results\\s*$', '')) AS title FROM t)
    SELECT o_orderkey, title, regexp_extract(title, '^([A-Z]+-[A-Z])\\b', 1) AS code, regexp_extract(title, 'Practice Exam (\\d+)', 1)::INT AS number, nullif(lower(regexp_extract(title, ':\\s*(\\w+) Mode\\s*$', 1)), '') AS mode,
      'exam-' || CASE WHEN regexp_extract(title, 'Practice Exam (\\d+)', 1)::INT < 10 THEN '0' ELSE '' END || regexp_extract(title, 'Practice Exam (\\d+)', 1) AS slug FROM c""",
)
def exam_title_fields(bank):
    raw = F.concat(F.lit("CERT-"), "o_orderstatus", F.lit(" Full Practice Exam "), (F.col("o_custkey") % 130).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ": Hard Mode").otherwise(""), F.lit(" - Results"))
    return bank.table("orders").select("o_orderkey", tx.exam_title_fields(raw).alias("f")).select("o_orderkey", "f.*")


# ------------------------------------------------------------ text functions


@query("slugs", f"SELECT doc_id, {B.SLUG.format(x='text')} AS slug FROM documents")
def slugs(bank):
    return bank.table("documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("normalised_text", "SELECT doc_id, sha256(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalised_text(bank):
    return bank.table("documents").select("doc_id", F.sha2(tx.norm(F.col("text")), 256).alias("digest"))


# Whole texts, but for the characters that are markup themselves.
@query(
    "stripped_markdown",
    """WITH t AS (SELECT doc_id, translate(text, '*[]()`\\', '') AS x FROM documents)
    SELECT doc_id, sha256(trim(regexp_replace(replace(x || ' ' || x || ' ' || x || ' a*b[' || doc_id || '](https://n) c_d *e', chr(160), ' '), '\\s+', ' ', 'g'))) AS digest FROM t""",
)
def stripped_markdown(bank):
    x, n = F.col("x"), F.col("doc_id").cast("string")
    md = F.concat(F.lit("**"), x, F.lit("** ["), x, F.lit("](https://e.org/"), n, F.lit(") *"), x, F.lit("* `a*b["), n, F.lit("](https://n)` c\\_d \\*e"))
    # Step by step: what a step reads more than once is computed once.
    bare = bank.table("documents").select("doc_id", tx.replaced(F.col("text"), "*[]()`\\").alias("x"))
    return bare.select("doc_id", md.alias("md")).select("doc_id", F.sha2(tx.strip_markdown(F.col("md")), 256).alias("digest"))


_MARKED = "replace(text, '. ', CASE doc_id % 7 " + " ".join(
    f"WHEN {i} THEN '.' || chr(10) || '{m}'" for i, m in enumerate(["# ", "- ", "1. ", "> ", "| a |" + "' || chr(10) || '", "<b>"])
) + " ELSE ' ![x](y) ' END)"


def _violation_sql() -> str:
    # The given texts hold no backticks, so nothing is masked in this twin.
    parts = []
    for name, rx in tx.MARKDOWN_VIOLATIONS.items():
        quoted = rx.replace("'", "''")
        parts.append(f"SELECT doc_id, '{name}' AS what, length(regexp_split_to_array(text, '(?m){quoted}')[1])::INT AS \"at\" FROM marked WHERE regexp_matches(text, '(?m){quoted}')")
    return f"WITH marked AS (SELECT doc_id, {_MARKED} AS text FROM documents) " + " UNION ALL ".join(parts)


@query("markdown_violations", _violation_sql())
def markdown_violations(bank):
    joiner = F.get(F.array(*[F.lit(".\n" + m) for m in ("# ", "- ", "1. ", "> ", "| a |\n", "<b>")], F.lit(" ![x](y) ")), F.col("doc_id") % 7)
    d = bank.table("documents").withColumn("text", F.replace("text", F.lit(". "), joiner))
    return d.select("doc_id", F.explode(tx.markdown_violations(F.col("text"))).alias("v")).select("doc_id", "v.*")


@query(
    "weight_fields",
    """WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || '%' WHEN 1 THEN p_size || '-' || (p_size + 5) || '%' ELSE 'about ' || p_size END AS raw, p_size FROM part)
    SELECT p_partkey, raw, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END AS weight_pct, CASE WHEN p_size % 3 = 1 THEN p_size::DOUBLE END AS weight_min, CASE WHEN p_size % 3 = 1 THEN (p_size + 5)::DOUBLE END AS weight_max FROM t""",
)
def weight_fields(bank):
    s = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(s, F.lit("%"))).when(F.col("p_size") % 3 == 1, F.concat(s, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("about "), s))
    return bank.table("part").select("p_partkey", raw.alias("raw")).withColumn("w", tx.weight_fields(F.col("raw"))).select("p_partkey", "raw", "w.*")
