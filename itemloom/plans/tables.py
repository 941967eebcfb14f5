"""Queries: projection tables, diffs, verification, data quality, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemloom import schemas
from itemloom.operators import diff, projection as P, quality as Q, scope as S, state
from itemloom.plans import bindings as B
from itemloom.plans.registry import query
from itemloom.session import work_path
from itemloom.sources import marks_blob, shards, sinks

R = f"WITH {B.RECORD}"
C = f"WITH {B.CITATION}"
_slug = lambda x: B.SLUG.format(x=x)


def _cited(bank):
    return P.citations(bank.record, B.MIRROR_DOCS, B.MIRROR_SUPPORT)


@query(
    "certification_rows",
    f"""{R} SELECT cert AS id, arg_min(cert_name, n) AS name, arg_min(vendor, n) AS vendor, first(level ORDER BY n) AS level, count(*) AS question_count FROM record GROUP BY cert""",
)
def certification_rows(bank):
    return P.certification_rows(bank.record)


@query(
    "exam_rows",
    f"""{R} SELECT cert || '/' || exam_slug AS id, first(cert ORDER BY n) AS certification_id, first(exam_slug ORDER BY n) AS slug,
    first(coalesce(exam_title, exam_slug) ORDER BY n) AS title, first(exam_number ORDER BY n) AS number, first(exam_mode ORDER BY n) AS mode, count(*) AS question_count
    FROM record WHERE exam_slug IS NOT NULL GROUP BY cert, exam_slug""",
)
def exam_rows(bank):
    return P.exam_rows(bank.record)


@query(
    "domain_rows",
    f"""{R} SELECT cert || '/' || {_slug('domain')} AS id, first(cert ORDER BY n) AS certification_id, first(domain ORDER BY n) AS label, {_slug('first(domain ORDER BY n)')} AS slug, count(*) AS question_count
    FROM record WHERE domain IS NOT NULL GROUP BY cert || '/' || {_slug('domain')}""",
)
def domain_rows(bank):
    return P.domain_rows(bank.record)


_QUESTION_SQL = f"""SELECT id, content_hash, cert AS certification_id, CASE WHEN exam_slug IS NOT NULL THEN cert || '/' || exam_slug END AS exam_id,
    cert || '/' || {_slug('domain')} AS domain_id, domain AS domain_label, question_number, type, coalesce(nullif(n_correct, 0), 1)::INT AS select_count,
    prompt_md, overall_explanation_md, array_to_string(correct_labels, ',') AS correct_labels,
    coalesce(origin_given, CASE provider WHEN 'en' THEN 'vendor_dump' WHEN 'fr' THEN 'official_sample' WHEN 'de' THEN 'local_generation' WHEN 'es' THEN 'hand_written' END) AS origin,
    provider AS source_provider, 'pages/' || n AS source_file, 'https://example.org/' || cert AS source_course_url FROM full_record"""


@query("question_rows", f"{R} {_QUESTION_SQL}")
def question_rows(bank):
    return _questions(bank)


def _questions(bank):
    rows = P.question_rows(bank.record, origins=B.ORIGINS).drop(
        "shard_id", "prompt_sha256", "normalized_sha256", "item_sha256"
    )
    return rows.withColumn("correct_labels", F.array_join("correct_labels", ","))


@query(
    "dedup_hashes",
    f"""{R} SELECT id, sha256(prompt_md) AS prompt_sha256, sha256(nrm) AS normalized_sha256, sha256(nrm || '␞' || lower(trim(regexp_replace(replace(array_to_string(texts, '␟'), chr(160), ' '), '\\s+', ' ', 'g')))) AS item_sha256
    FROM (SELECT *, lower(trim(regexp_replace(replace(prompt_md, chr(160), ' '), '\\s+', ' ', 'g'))) AS nrm FROM record)""",
)
def dedup_hashes(bank):
    return P.question_rows(bank.record, origins=B.ORIGINS).select("id", "prompt_sha256", "normalized_sha256", "item_sha256")


@query("content_hash", f"{R} SELECT id, content_hash FROM full_record")
def content_hash(bank):
    return bank.record.select("id", "content_hash")


@query(
    "question_option_rows",
    f"{R} SELECT oid || '#' || label AS id, oid AS question_id, label, position, text_md, is_correct, explanation_md FROM options_of",
)
def question_option_rows(bank):
    return P.option_rows(bank.record)


@query(
    "reference_rows",
    f"""{C}, r AS (SELECT reference_id AS id, min(raw_url) AS display_url, count(DISTINCT question_id) AS question_count FROM citation GROUP BY reference_id)
    SELECT id, display_url, nullif(split_part(CASE WHEN contains(display_url, '://') THEN split_part(display_url, '://', 2) ELSE display_url END, '/', 1), '') AS host, question_count FROM r""",
)
def reference_rows(bank):
    return P.reference_rows(_cited(bank))


@query(
    "question_reference_rows",
    f"{C} SELECT question_id, reference_id, min(position) AS position, arg_min(raw_url, position) AS raw_url FROM citation GROUP BY ALL",
)
def question_reference_rows(bank):
    return P.question_reference_rows(_cited(bank))


@query("normalised_references", f"{C} SELECT question_id, position, raw_url, reference_id FROM citation")
def normalised_references(bank):
    return _cited(bank)


@query(
    "unknown_providers",
    f"{R} SELECT id, provider FROM record WHERE origin_given IS NULL AND provider NOT IN ('en', 'fr', 'de')",
)
def unknown_providers(bank):
    return P.unknown_providers(bank.record, {k: v for k, v in B.ORIGINS.items() if k != "es"})


@query(
    "provider_first_shard",
    "SELECT lang AS provider, arg_min(source, doc_id) AS shard_id FROM documents GROUP BY lang",
)
def provider_first_shard(bank):
    rows = bank.table("documents").select(F.col("lang").alias("provider"), F.col("source").alias("path"), F.col("doc_id").alias("ordinal"))
    return P.provider_shards(rows)


# -------------------------------------------------------- blueprint tables

_TREE = """node AS (
  SELECT 'vendor/' || r_name || '/v1' AS blueprint_id, r_name AS cert, path, len(string_split(path, '.'))::INT AS depth, label, weight FROM (
    SELECT r_name, (n_nationkey // 5 + 1)::VARCHAR AS path, n_name AS label, n_nationkey::DOUBLE AS weight FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT r_name, (n_nationkey // 5 + 1) || '.' || (c_custkey + 1), c_name, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey))"""


def _nodes(bank):
    """Blueprint nodes in long form: nations under a region, customers under a nation."""
    nation = bank.table("nation").join(bank.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    top = (F.floor(F.col("n_nationkey") / 5) + 1).cast("string")
    first = nation.select("r_name", top.alias("path"), F.lit(1).alias("depth"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("double").alias("weight_pct"))
    below = bank.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "r_name", F.concat_ws(".", top, (F.col("c_custkey") + 1).cast("string")).alias("path"), F.lit(2).alias("depth"), F.col("c_name").alias("label"), F.lit(None).cast("double").alias("weight_pct")
    )
    return first.unionByName(below).select(F.concat(F.lit("vendor/"), "r_name", F.lit("/v1")).alias("blueprint_id"), "r_name", "path", "depth", "label", "weight_pct")


@query(
    "blueprint_node_rows",
    f"""WITH {_TREE} SELECT blueprint_id || '#' || path AS id, blueprint_id, CASE WHEN contains(path, '.') THEN blueprint_id || '#' || regexp_replace(path, '\\.[^.]*$', '') END AS parent_id, path, depth, label, weight AS weight_pct FROM node""",
)
def blueprint_node_rows(bank):
    # One single-node record per row keeps a blueprint of any size spread over tasks.
    records = _nodes(bank).select(
        F.col("blueprint_id").alias("id"), F.array(F.struct("path", "depth", "label", "weight_pct")).alias("nodes")
    )
    return P.blueprint_node_rows(records)


@query(
    "blueprint_rows",
    """SELECT 'vendor/' || r_name || '/v1' AS id, r_name AS certification_id, 'vendor' AS vendor, 'v1' AS version_label, NULL::VARCHAR AS effective_from, 'exact' AS weight_regime,
    sum(n_nationkey)::DOUBLE AS weights_sum, sum(n_nationkey) = 100 AS weights_sum_to_100, 2 AS max_depth, TRUE AS is_current FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def blueprint_rows(bank):
    return P.blueprint_rows(_blueprints(bank))


def _blueprints(bank):
    nation = bank.table("nation").join(bank.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    total = F.sum("n_nationkey").cast("double")
    return nation.groupBy("r_name").agg(total.alias("weights_sum")).select(
        F.concat(F.lit("vendor/"), "r_name", F.lit("/v1")).alias("id"), F.col("r_name").alias("certification"), F.concat(F.lit("Region "), "r_name").alias("name"),
        F.lit("vendor").alias("vendor"), F.lit("v1").alias("version_label"), F.lit(None).cast("string").alias("effective_from"), F.lit("exact").alias("weight_regime"),
        "weights_sum", (F.col("weights_sum") == 100).alias("weights_sum_to_100"), F.lit(2).alias("max_depth"),
    )


@query(
    "blueprint_source_rows",
    """SELECT 'vendor/' || r_name || '/v1#guides/' || n_name AS id, 'vendor/' || r_name || '/v1' AS blueprint_id, 'guides/' || n_name AS path, sha256(n_name) AS sha256, 'pdf' AS kind
    FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def blueprint_source_rows(bank):
    nation = bank.table("nation").join(bank.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    records = nation.select(
        F.concat(F.lit("vendor/"), "r_name", F.lit("/v1")).alias("id"),
        F.array(F.struct(F.concat(F.lit("guides/"), "n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), F.lit("pdf").alias("kind"))).alias("sources"),
    )
    return P.blueprint_source_rows(records)


@query(
    "certifications_from_blueprints",
    f"""{R} SELECT cert AS id, arg_min(cert_name, n) AS name, arg_min(vendor, n) AS vendor, first(level ORDER BY n) AS level, count(*) AS question_count FROM record GROUP BY cert
    UNION ALL SELECT r_name, 'Region ' || r_name, 'vendor', NULL, 0 FROM region WHERE r_name NOT IN (SELECT lang FROM documents) AND r_regionkey IN (SELECT n_regionkey FROM nation)""",
)
def certifications_from_blueprints(bank):
    return P.with_blueprint_certifications(P.certification_rows(bank.record), _blueprints(bank))


@query(
    "domain_map_rows",
    f"""WITH dom AS (SELECT r_name AS cert, n_name AS label, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL), {_TREE}
    SELECT dom.cert || '/' || {_slug('dom.label')} AS domain_id, blueprint_id || '#' || path AS node_id, 'exact' AS join_method FROM dom JOIN node ON node.cert = dom.cert AND node.label = dom.label AND depth = 1""",
)
def domain_map_rows(bank):
    from itemloom.functions.text import slugify

    nation = bank.table("nation").join(bank.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dom = (
        bank.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("r_name").alias("certification_id"), F.col("n_name").alias("label")).distinct()
        .withColumn("id", F.concat_ws("/", "certification_id", slugify(F.col("label"))))
    )
    nodes = _nodes(bank).withColumn("id", F.concat_ws("#", "blueprint_id", "path")).withColumn("ordinal", F.col("path"))
    return P.domain_map_rows(dom, _blueprints(bank).select("id", F.col("certification").alias("certification_id")), nodes)


# ------------------------------------------------------ detail, snapshots


def detail(bank):
    scope = bank.record.select("*", F.col("certification.slug").alias("certification_id"), F.col("domain").alias("domain_label"), P.exam_id().alias("exam_id")).drop("options", "references")
    return P.question_detail(scope, P.option_rows(bank.record), P.question_reference_rows(_cited(bank)), P.reference_rows(_cited(bank)))


@query(
    "question_detail",
    f"""{C}, refs AS (SELECT reference_id, count(DISTINCT question_id) AS question_count, min(raw_url) AS display_url FROM citation GROUP BY 1),
    qr AS (SELECT question_id, reference_id, min(position) AS position FROM citation GROUP BY ALL),
    cited AS (SELECT question_id, string_agg(position || '=' || display_url || '*' || question_count, ' ' ORDER BY position, qr.reference_id) AS refs FROM qr JOIN refs ON refs.reference_id = qr.reference_id GROUP BY 1),
    opts AS (SELECT oid, string_agg(label || '=' || text_md || '=' || coalesce(explanation_md, '-'), '|' ORDER BY position) AS opts FROM options_of GROUP BY 1)
    SELECT r.id, r.prompt_md, opts.opts AS options, cited.refs AS reference_list FROM record r LEFT JOIN opts ON oid = r.id LEFT JOIN cited ON question_id = r.id""",
)
def question_detail(bank):
    d = detail(bank)
    opts = F.transform("options", lambda o: F.concat_ws("=", o["label"], o["text_md"], F.coalesce(o["explanation_md"], F.lit("-"))))
    refs = F.transform("references", lambda r: F.concat(r["position"].cast("string"), F.lit("="), r["display_url"], F.lit("*"), r["question_count"].cast("string")))
    return d.select("id", "prompt_md", F.array_join(opts, "|").alias("options"), F.array_join(refs, " ").alias("reference_list"))


@query(
    "question_snapshot",
    f"""{R}, opts AS (SELECT oid, string_agg(label || ':' || is_correct::VARCHAR, ',' ORDER BY position) AS opts FROM options_of GROUP BY 1)
    SELECT id AS question_id, type, n_correct::INT AS select_count, array_to_string(correct_labels, ',') AS correct_labels, domain AS domain_label, opts FROM full_record LEFT JOIN opts ON oid = id""",
)
def question_snapshot(bank):
    d = detail(bank).select(P.snapshot().alias("s"))
    opts = F.transform("s.options", lambda o: F.concat_ws(":", o["label"], o["is_correct"].cast("string")))
    return d.select("s.question_id", "s.type", "s.select_count", F.array_join("s.correct_labels", ",").alias("correct_labels"), "s.domain_label", F.array_join(opts, ",").alias("opts"))


@query(
    "replay_states",
    f"""WITH {B.GRADED_ITEM} SELECT id, array_to_string(list_transform(list_reverse(option_labels), lambda x: x || ':' || CASE WHEN list_contains(correct_labels, x) AND list_contains(selected_labels, x) THEN 'right'
      WHEN list_contains(correct_labels, x) THEN 'missed' WHEN list_contains(selected_labels, x) THEN 'wrong' ELSE 'plain' END), ',') AS states FROM graded_item""",
)
def replay_states(bank):
    options = F.transform("option_labels", lambda x: F.struct(x.alias("label"), x.alias("text_md")))
    shown = P.replay_options(F.reverse("option_labels"), options, F.col("correct_labels"), F.col("selected_labels"))
    return bank.graded_item.select("id", F.array_join(F.transform(shown, lambda o: F.concat_ws(":", o["label"], o["state"])), ",").alias("states"))


@query("answer_safe_options", f"{R} SELECT oid AS id, string_agg(label || '=' || text_md, '|' ORDER BY position) AS shown FROM options_of GROUP BY oid")
def answer_safe_options(bank):
    safe = F.transform(P.answer_safe(F.col("options")), lambda o: F.concat_ws("=", o["label"], o["text_md"]))
    return bank.record.where(F.size("options") > 0).select("id", F.array_join(safe, "|").alias("shown"))


# ------------------------------------------------------------------ diffs

_OLD = "old AS (SELECT doc_id AS id, text, source, n_chars FROM documents)"
_NEW = """new AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, source, n_chars FROM documents WHERE doc_id % 10 <> 0
    UNION ALL SELECT 1000000000 + page_id, html, 'pages', length(html) FROM pages)"""
_PLAN = f"""WITH {_OLD}, {_NEW}, plan AS (SELECT coalesce(n.id, o.id) AS id, n.text, n.source, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete'
    WHEN n.text IS DISTINCT FROM o.text OR n.source IS DISTINCT FROM o.source OR n.n_chars IS DISTINCT FROM o.n_chars THEN 'update' ELSE 'unchanged' END AS change
    FROM new n FULL JOIN old o ON o.id = n.id)"""


def _versions(bank):
    old = bank.table("documents").select(F.col("doc_id").alias("id"), "text", "source", "n_chars")
    edited = old.where(F.col("id") % 10 != 0).withColumn("text", F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = bank.table("pages").select((F.lit(1000000000) + F.col("page_id")).alias("id"), F.col("html").alias("text"), F.lit("pages").alias("source"), F.length("html").cast("bigint").alias("n_chars"))
    return old, edited.unionByName(added)


def _plan(bank):
    old, new = _versions(bank)
    return diff.plan_table(new, old, ["id"])


@query("table_plan", f"{_PLAN} SELECT id, source, change FROM plan")
def table_plan(bank):
    return _plan(bank).select("id", "source", "change")


@query("table_plan_applied", f"{_PLAN} SELECT id, sha256(text) AS text_hash, source, 'r2' AS ingest_run_id FROM plan WHERE change <> 'delete'")
def table_plan_applied(bank):
    return diff.apply_plan(_plan(bank), "r2").select("id", F.sha2("text", 256).alias("text_hash"), "source", "ingest_run_id")


@query("table_changes", f"{_PLAN} SELECT id, sha256(text) AS text_hash, change FROM plan WHERE change <> 'unchanged'")
def table_changes(bank):
    old, new = _versions(bank)
    return diff.changed_rows(new, old, ["id"]).select("id", F.sha2("text", 256).alias("text_hash"), "change")


@query(
    "plan_duplicate_keys",
    """WITH l AS (SELECT l_orderkey AS id, l_linenumber % 4 AS part, l_quantity FROM lineitem)
    SELECT 'desired' AS side, id, part, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'existing', id, part, count(*) FROM l WHERE l_quantity > 10 GROUP BY ALL HAVING count(*) > 1""",
)
def plan_duplicate_keys(bank):
    rows = bank.table("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).alias("part"), "l_quantity")
    return diff.refused_keys(rows, rows.where(F.col("l_quantity") > 10), ["id", "part"])


@query(
    "apply_unchanged",
    f"""WITH {_OLD}, {_NEW} SELECT 'r1' AS run_id, TRUE AS published, (SELECT count(*) FROM old) AS rows, FALSE AS current UNION ALL SELECT 'r2', FALSE, NULL, FALSE
    UNION ALL SELECT 'r3', TRUE, (SELECT count(*) FROM new), TRUE UNION ALL SELECT 'r4', FALSE, NULL, FALSE""",
)
def apply_unchanged(bank):
    """The documents published, published again, changed, and once more: what each run wrote."""
    base = work_path(bank.spark, "published")
    old, new = _versions(bank)
    for run, table in (("r1", old), ("r2", old), ("r3", new), ("r4", new)):
        sinks.publish_changes(table, base, run, ["id"])
    runs = bank.spark.createDataFrame([(f"r{i}",) for i in range(1, 5)], "run_id string")
    done = sinks.versions(bank.spark, base)
    newest = done.agg(F.max("seq").alias("newest"))
    marked = done.join(newest, F.col("seq") == F.col("newest"), "left")
    return runs.join(marked, "run_id", "left").select(
        "run_id", F.col("seq").isNotNull().alias("published"), "rows", F.col("newest").isNotNull().alias("current")
    )


@query(
    "change_summary",
    f"""{_PLAN} SELECT 'document' AS table_name, count(*) FILTER (change = 'insert') AS inserted, count(*) FILTER (change = 'update') AS updated, count(*) FILTER (change = 'delete') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM plan""",
)
def change_summary(bank):
    return diff.change_summary({"document": _plan(bank)})


@query(
    "verify_round_trip",
    f"""WITH {_OLD}, {_NEW}, j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS oid, n.id AS nid, o.text AS ot, n.text AS nt FROM old o FULL JOIN new n ON n.id = o.id)
    SELECT id, 'missing' AS problem FROM j WHERE nid IS NULL UNION ALL SELECT id, 'unexpected' FROM j WHERE oid IS NULL UNION ALL SELECT id, 'text' FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND ot IS DISTINCT FROM nt""",
)
def verify_round_trip(bank):
    old, new = _versions(bank)
    return diff.verify_fields(old, new, "id", ["text", "source", "n_chars"])


@query(
    "verify_summary",
    f"""WITH {_OLD}, {_NEW}, j AS (SELECT o.id AS oid, n.id AS nid, o.text AS ot, n.text AS nt FROM old o FULL JOIN new n ON n.id = o.id)
    SELECT 3 * count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL) AS fields_checked, count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL AND ot IS DISTINCT FROM nt) AS mismatches,
      count(*) FILTER (nid IS NULL) AS missing, count(*) FILTER (oid IS NULL) AS unexpected FROM j""",
)
def verify_summary(bank):
    old, new = _versions(bank)
    return diff.verify_summary(old, new, "id", ["text", "source", "n_chars"])


@query("keys_missing", f"WITH {_OLD}, {_NEW} SELECT id FROM old EXCEPT SELECT id FROM new")
def keys_missing(bank):
    old, new = _versions(bank)
    return diff.missing_keys(old, new, "id")


@query("keys_unexpected", f"WITH {_OLD}, {_NEW} SELECT id FROM new EXCEPT SELECT id FROM old")
def keys_unexpected(bank):
    old, new = _versions(bank)
    return diff.missing_keys(new, old, "id")


@query(
    "affected_questions",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT DISTINCT question_id FROM (SELECT doc_id::VARCHAR AS question_id FROM documents WHERE n_chars % 7 = 0 UNION ALL SELECT doc_id::VARCHAR FROM lines WHERE length(line) % 11 = 0)""",
)
def affected_questions(bank):
    d = bank.table("documents").select(F.col("doc_id").cast("string").alias("id"), "n_chars", "text")
    new_q = d.select("id", F.when(F.col("n_chars") % 7 == 0, -1).otherwise(F.col("n_chars")).alias("v"))
    lines = d.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(F.concat_ws("#", "id", F.col("pos").cast("string")).alias("id"), F.length("line").alias("v"))
    new_l = lines.select("id", F.when(F.col("v") % 11 == 0, -1).otherwise(F.col("v")).alias("v"))
    return diff.affected_questions(diff.plan_table(new_q, d.select("id", F.col("n_chars").alias("v")), ["id"]), diff.plan_table(new_l, lines, ["id"]))


# ------------------------------------------------------------ data quality


@query(
    "corpus_problems",
    f"""{R}, fr AS (SELECT * FROM full_record), dup AS (SELECT content_hash, arg_min(id, n) AS first_id, min(n) AS first_n FROM fr GROUP BY 1 HAVING count(*) > 1)
    SELECT id, n_options || ' options (expected 4)' AS problem FROM fr WHERE n_options <> 4
    UNION ALL SELECT id, 'empty prompt' FROM fr WHERE coalesce(prompt_md, '') = '' UNION ALL SELECT id, 'empty domain' FROM fr WHERE coalesce(domain, '') = ''
    UNION ALL SELECT id, 'empty overall explanation' FROM fr WHERE coalesce(overall_explanation_md, '') = ''
    UNION ALL SELECT id, 'single_select with ' || n_correct || ' correct' FROM fr WHERE type = 'single_select' AND n_correct <> 1
    UNION ALL SELECT id, 'multi_select with ' || n_correct || ' correct' FROM fr WHERE type = 'multi_select' AND n_correct < 2
    UNION ALL SELECT oid, 'option ' || label || ': empty text' FROM options_of WHERE coalesce(text_md, '') = ''
    UNION ALL SELECT oid, 'option ' || label || ': empty explanation' FROM options_of WHERE coalesce(explanation_md, '') = ''
    UNION ALL SELECT id, 'duplicate content, same as ' || first_id FROM fr JOIN dup ON dup.content_hash = fr.content_hash WHERE n <> first_n""",
)
def corpus_problems(bank):
    return Q.corpus_problems(bank.record)


@query("values_not_accepted", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def values_not_accepted(bank):
    return Q.not_accepted(bank.table("events"), "event_type", ("click", "view")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("values_out_of_range", "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 40")
def values_out_of_range(bank):
    return Q.out_of_range(bank.table("part"), "p_size", 5, 40).select("p_partkey", "p_size")


@query("keys_not_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def keys_not_unique(bank):
    return Q.not_unique(bank.table("lineitem"), "l_orderkey", "l_linenumber")


@query("orphan_rows", "SELECT e.user_id, e.event_id FROM events e WHERE e.user_id NOT IN (SELECT doc_id FROM labels)")
def orphan_rows(bank):
    return Q.orphans(bank.table("events"), "user_id", bank.table("labels"), "doc_id").select("user_id", "event_id")


@query(
    "snapshot_drift",
    f"""WITH {_OLD}, {_NEW} SELECT o.id FROM old o JOIN new n ON n.id = o.id WHERE o.source <> 'src1' AND (o.text IS DISTINCT FROM n.text OR o.n_chars IS DISTINCT FROM n.n_chars)""",
)
def snapshot_drift(bank):
    old, new = _versions(bank)
    answered = old.withColumn("answered", F.when(F.col("source") != "src1", F.lit(1)))
    return Q.snapshot_drift(answered, new, "id", ["text", "n_chars"], "answered").select("id")


@query(
    "several_open_attempts",
    f"WITH {B.ATTEMPT} SELECT certification_id, count(*) FILTER (submitted_at IS NULL AND abandoned_at IS NULL) AS open FROM attempt GROUP BY 1 HAVING open > 1",
)
def several_open_attempts(bank):
    return Q.several_open_attempts(bank.attempt)


@query(
    "search_index_consistency",
    """SELECT count(i.doc_id) FILTER (i.doc_id IS NOT NULL) AS rows_indexed, count(d.doc_id) AS questions, count(*) FILTER (d.doc_id IS NULL) AS orphans,
      count(i.doc_id) = count(d.doc_id) AND count(*) FILTER (d.doc_id IS NULL) = 0 AS consistent
    FROM documents d FULL JOIN labels i ON i.doc_id = d.doc_id""",
)
def search_index_consistency(bank):
    return Q.index_consistency(bank.table("labels").select(F.col("doc_id").alias("question_id")), bank.table("documents").select(F.col("doc_id").alias("id")))


# ------------------------------------------------------------------ shards


@query(
    "shard_index_rows",
    """SELECT source AS path, CASE WHEN min(lang) = max(lang) THEN min(lang) ELSE 'mixed' END AS provider, count(*) AS line_count FROM documents GROUP BY source""",
)
def shard_index_rows(bank):
    return shards.index_rows(bank.table("documents"), "source", F.col("lang"))


SINK_GLOB = "questions/cert=*/*.json"


def _shards(bank) -> str:
    """The records as canonical shards, a folder a certification."""
    kb = work_path(bank.spark, "shards")
    sinks.write_records(bank.record.drop("order_key"), f"{kb}/questions")
    return kb


@query("shard_discovery", "SELECT DISTINCT lang AS certification_id, 1::INT AS rank, TRUE AS filled, 0::BIGINT AS unread FROM documents")
def shard_discovery(bank):
    """Per certification: its shard files are found, hold bytes, and the scan reads each of them."""
    kb = _shards(bank)
    found = shards.discover_shards(bank.spark, kb, SINK_GLOB)
    read = shards.scan_questions(bank.spark, kb, glob=SINK_GLOB).select(F.col("shard_path").alias("path")).distinct()
    marked = found.join(read.withColumn("read", F.lit(True)), "path", "left")
    return marked.groupBy(F.regexp_extract("path", "cert=([^/]*)", 1).alias("certification_id"), "rank").agg(
        (F.min("length") > 0).alias("filled"), F.count_if(F.col("read").isNull()).alias("unread")
    )


@query(
    "shard_scan",
    f"""{R} SELECT r.id, cert AS certification_id, exam_slug, domain, sha256(prompt_md) AS prompt_hash, sha256(overall_explanation_md) AS explanation_hash, len(texts)::INT AS options,
      coalesce(array_to_string(correct_labels, ','), '') AS key, array_to_string(refs, '|') AS refs FROM record r LEFT JOIN key_of k ON k.oid = r.id""",
)
def shard_scan(bank):
    """The records written as shards and scanned again."""
    rows = shards.scan_questions(bank.spark, _shards(bank), glob=SINK_GLOB)
    return rows.select(
        "id",
        F.col("certification.slug").alias("certification_id"),
        F.col("exam.slug").alias("exam_slug"),
        "domain",
        F.sha2("prompt_md", 256).alias("prompt_hash"),
        F.sha2("overall_explanation_md", 256).alias("explanation_hash"),
        F.size("options").alias("options"),
        F.array_join("correct_labels", ",").alias("key"),
        F.array_join("references", "|").alias("refs"),
    )


@query(
    "blueprint_scan",
    """SELECT 'v/' || s_name || '/1#' || p AS id, 'v/' || s_name || '/1' AS blueprint_id, CASE WHEN p <> '1' THEN 'v/' || s_name || '/1#1' END AS parent_id, p AS path, len(string_split(p, '.'))::INT AS depth,
      CASE p WHEN '1' THEN 'nation ' || s_nationkey ELSE 'part ' || p END AS label, CASE p WHEN '1' THEN 100.0::DOUBLE END AS weight_pct FROM supplier, (VALUES ('1'), ('1.1'), ('1.2')) n(p)""",
)
def blueprint_scan(bank):
    """A blueprint file a supplier, written, scanned and flattened to its nodes."""
    kb = work_path(bank.spark, "blueprints")

    def node(path, label, weight=None):
        depth = path.count(".") + 1
        return F.struct(
            F.lit(path).alias("path"), F.lit(depth).alias("depth"), F.lit(int(path[-1])).alias("ordinal"), label.alias("label"), F.lit(weight).cast("double").alias("weight_pct")
        )

    nodes = F.array(node("1", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), 100.0), *[node(p, F.lit(f"part {p}")) for p in ("1.1", "1.2")])
    files = bank.table("supplier").select(
        F.concat(F.lit("v/"), "s_name", F.lit("/1")).alias("id"), F.col("s_name").alias("certification"), F.lit("v").alias("vendor"), F.lit("exact").alias("weight_regime"), nodes.alias("nodes")
    )
    # Dealt out: the suppliers of one file would be written by one task.  Each task puts its own files in place.
    dealt = files.repartition(4 * bank.spark.sparkContext.defaultParallelism, "id")
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(f"{kb}/blueprints")
    return P.blueprint_node_rows(shards.scan_blueprints(bank.spark, kb)).select("id", "blueprint_id", "parent_id", "path", "depth", "label", "weight_pct")


@query("current_ingest_run", "SELECT 'r' || r_regionkey AS id, r_name FROM region WHERE r_regionkey = 2 AND EXISTS (SELECT 1 FROM documents WHERE doc_id % 10 <> 0)")
def current_ingest_run(bank):
    runs = bank.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), "r_name")
    return diff.current_run(diff.apply_plan(_plan(bank), "r2"), runs)


@query("shard_index_refusals", "SELECT source AS path, 'mixed' AS provider, count(*) AS line_count FROM documents GROUP BY source HAVING min(lang) <> max(lang)")
def shard_index_refusals(bank):
    return shards.mixed_shards(shard_index_rows(bank))


@query("table_file_index")
def table_file_index(bank):
    """Per table file: rows (scan metadata) and content digest."""
    rows = bank.table("documents").select("*", F.col("_metadata.file_path").alias("shard_path"))
    index = shards.index_rows(rows, "shard_path", F.col("lang"))
    listed = bank.spark.read.format("binaryFile").load(f"{bank.sf_dir}/documents.parquet")
    lengths = listed.select(F.col("_metadata.file_path").alias("path"), "length")
    files = lengths.join(shards.row_digests(bank.table("documents"), F.col("_metadata.file_path")), "path")
    name = lambda c: F.substring_index(c, "/", -1)
    return files.withColumn("path", name(F.col("path"))).join(index.withColumn("path", name(F.col("path"))), "path")


@query(
    "shard_index_staleness",
    """WITH f AS (SELECT DISTINCT source AS path FROM documents WHERE lang <> 'es'), i AS (SELECT DISTINCT source AS path FROM documents WHERE n_chars < 1000 AND lang = 'es')
    SELECT path, 'unlisted' AS problem FROM f WHERE path NOT IN (SELECT path FROM i) UNION ALL SELECT path, 'absent' FROM i WHERE path NOT IN (SELECT path FROM f)""",
)
def shard_index_staleness(bank):
    d = bank.table("documents")
    found = d.where(F.col("lang") != "es").select(F.col("source").alias("path")).distinct()
    index = d.where((F.col("n_chars") < 1000) & (F.col("lang") == "es")).select(F.col("source").alias("path")).distinct()
    return shards.index_staleness(found, index)


@query(
    "shard_index_freshness",
    """WITH a AS (SELECT source AS path, count(*) AS c, max(lang) AS p FROM documents WHERE doc_id % 97 <> 0 GROUP BY 1), b AS (SELECT source AS path, count(*) AS c, max(lang) AS p FROM documents GROUP BY 1)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path
    WHERE a.path IS NULL OR b.path IS NULL OR a.c <> b.c OR a.p IS DISTINCT FROM b.p""",
)
def shard_index_freshness(bank):
    d = bank.table("documents")
    build = lambda x: x.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("line_count"), F.max("lang").alias("provider"))
    return shards.index_changes(build(d.where(F.col("doc_id") % 97 != 0)), build(d))


_FINGERPRINT = """files AS (SELECT 0 AS kind, source || '/' || doc_id AS path, sha256(text) AS sha FROM documents UNION ALL SELECT 1, 'item/' || item_id, sha256(text) FROM benchmark),
    d AS (SELECT left(md5(path), 3) AS bucket, sha256(string_agg(path || ':' || sha || chr(10), '' ORDER BY kind, path)) AS d FROM files GROUP BY 1),
    fp AS (SELECT sha256(string_agg(bucket || ':' || d || chr(10), '' ORDER BY bucket)) AS fingerprint FROM d)"""


def _fingerprint(bank):
    docs = bank.table("documents").select(F.lit(0).alias("kind"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    items = bank.table("benchmark").select(F.lit(1).alias("kind"), F.concat_ws("/", F.lit("item"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return shards.fingerprint(docs.unionByName(items))


@query("corpus_fingerprint", f"WITH {_FINGERPRINT} SELECT fingerprint FROM fp")
def corpus_fingerprint(bank):
    return _fingerprint(bank)


@query(
    "projection_state",
    f"""WITH {_FINGERPRINT}, v AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN fingerprint WHEN 1 THEN s_name END AS stored, CASE WHEN s_suppkey % 5 <> 3 THEN fingerprint END AS found FROM supplier, fp)
    SELECT id, CASE WHEN found IS NULL THEN 'no-corpus' WHEN stored IS NULL THEN 'not-ingested' WHEN stored <> found THEN 'stale' ELSE 'ready' END AS state FROM v""",
)
def projection_state(bank):
    """A projection a supplier: a quarter hold the corpus's digest, some see no corpus."""
    now, key = _fingerprint(bank).scalar(), F.col("s_suppkey")
    stored = F.when(key % 4 == 0, now).when(key % 4 == 1, F.col("s_name"))
    found = F.when(key % 5 != 3, now)
    return bank.table("supplier").select(key.alias("id"), diff.projection_state(stored, found).alias("state"))


@query(
    "marks_blob_rows",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'q' || user_id ELSE 'k' || event_id END AS question_id, event_type AS value FROM events""",
)
def marks_blob_rows(bank):
    e = bank.table("events")
    flat = F.concat(F.lit('{"k'), F.col("event_id").cast("string"), F.lit('":"'), "event_type", F.lit('"}'))
    shape = F.col("event_id") % 4
    raw = (
        F.when(shape == 0, flat)
        .when(shape == 1, F.concat(F.lit('{"marks":'), flat, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"kb-marks":"'), F.replace(flat, F.lit('"'), F.lit('\\"')), F.lit('"}')))
        .otherwise(F.concat(F.lit('[{"question_id":"q'), F.col("user_id").cast("string"), F.lit('","value":"'), "event_type", F.lit('"}]')))
    )
    return marks_blob.parse_blobs(e.select("event_id", raw.alias("raw")))


# -------------------------------------------------------------- exports


@query(
    "study_index",
    f"""WITH {B.QUESTION}, per AS (SELECT certification_id, domain_label, count(*) AS n, count(*) FILTER (type = 'single_select') AS single FROM question GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY certification_id ORDER BY domain_label)::INT AS position FROM per)
    SELECT certification_id, position, domain_label, n, single, n - single AS multi, (CASE WHEN position < 10 THEN '0' ELSE '' END) || position || '-' || {_slug('domain_label')} || '.md' AS filename FROM numbered""",
)
def study_index(bank):
    return sinks.study_index(bank.question)


@query("study_rows")
def study_rows(bank):
    return sinks.study_rows(bank.record)


@query(
    "manifest_totals",
    f"{R} SELECT count(DISTINCT cert || '/' || coalesce(exam_slug, '')) AS exams, count(*) AS questions, sum(n_options)::BIGINT AS options FROM full_record",
)
def manifest_totals(bank):
    return sinks.manifest_totals(bank.record)


@query(
    "manifest_cross_check",
    f"""{R}, m AS (SELECT sum(n_options)::BIGINT AS options, count(*) AS questions FROM full_record), t AS (SELECT (SELECT count(*) FROM options_of) AS options, (SELECT count(DISTINCT id) FROM record) AS questions)
    SELECT 'options' AS field, m.options AS manifest, t.options AS tables FROM m, t UNION ALL SELECT 'questions', m.questions, t.questions FROM m, t""",
)
def manifest_cross_check(bank):
    m = sinks.manifest_totals(bank.record)
    manifest = m.select(F.stack(F.lit(2), F.lit("options"), "options", F.lit("questions"), "questions").alias("field", "manifest"))
    tables = (
        P.option_rows(bank.record).agg(F.count(F.lit(1)).alias("tables")).withColumn("field", F.lit("options"))
        .unionByName(bank.record.agg(F.countDistinct("id").alias("tables")).withColumn("field", F.lit("questions")))
    )
    return manifest.join(tables, "field", "full_outer")
