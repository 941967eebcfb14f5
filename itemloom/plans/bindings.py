"""How the item-bank tables are derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions.text import content_hash

ORIGINS = {
    "en": "vendor_dump",
    "fr": "official_sample",
    "de": "local_generation",
    "es": "hand_written",
}
MARKS = ("click", "view", "purchase")
CLEARED = "error"
MIRROR_DOCS, MIRROR_SUPPORT = r"^m\.", r"^blog\."


def domain_label(n_chars: Column) -> Column:
    return (
        F.when(n_chars < 500, "Short & sweet")
        .when(n_chars < 2000, "Medium, plain")
        .when(n_chars < 8000, "Long-form")
        .otherwise("Very long")
    )


def _item_key(*columns: str) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


class Bank:
    """Lazy views of the given tables under item-bank names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- flat questions with their dimensions
    @property
    def question(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels")
        label = domain_label(F.col("n_chars"))
        origin = F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv])
        return d.join(lab, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            F.col("lang").alias("certification_id"),
            F.col("source").alias("exam_slug"),
            F.concat_ws("/", "lang", "source").alias("exam_id"),
            label.alias("domain_label"),
            F.concat_ws("/", F.col("lang"), label).alias("domain_id"),
            F.when(F.col("toxic") == 1, "multi_select").when(F.col("toxic") == 0, "single_select").alias("type"),
            origin[F.col("lang")].alias("origin"),
            F.col("text").alias("prompt_md"),
            F.col("n_chars"),
            F.col("quality"),
        )

    @property
    def exam(self) -> DataFrame:
        n = F.regexp_extract("source", r"(\d+)", 1)
        return (
            self.table("documents")
            .select("lang", "source")
            .distinct()
            .select(
                F.concat_ws("/", "lang", "source").alias("id"),
                F.col("lang").alias("certification_id"),
                F.col("source").alias("slug"),
                F.concat(F.lit("Exam "), F.col("source")).alias("title"),
                F.when(n.cast("int") % 3 == 0, "hard").when(n.cast("int") % 3 == 1, "easy").alias("mode"),
            )
        )

    @property
    def certification(self) -> DataFrame:
        return (
            self.table("documents")
            .select("lang")
            .distinct()
            .select(F.col("lang").alias("id"), F.concat(F.lit("Language "), F.upper("lang")).alias("name"))
        )

    # ---- nested records
    @property
    def citing_pages(self) -> DataFrame:
        """(page_id, references): the page's own address and its absolute links."""
        hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
        return self.table("pages").select(
            "page_id",
            F.concat(
                F.array("url"), F.transform(hrefs, lambda h: F.concat(F.lit("https://m.example.org/en"), h))
            ).alias("references"),
        )

    @property
    def record(self) -> DataFrame:
        """Documents as canonical nested question records (schemas.QUESTION + order_key)."""
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        d = d.join(self.citing_pages, F.col("doc_id") == F.col("page_id"), "left")
        n = F.nullif(F.regexp_extract("source", r"(\d+)", 1), F.lit("")).cast("int")
        parts = F.split("text", "\n")
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        options = F.transform(
            rest,
            lambda line, i: F.struct(
                F.concat(F.lit("o"), (i + 1).cast("string")).alias("label"),
                line.alias("text_md"),
                (F.length(line) % 3 == 0).alias("correct"),
                F.when(F.length(line) % 2 == 0, line).alias("explanation_md"),
            ),
        )
        correct = F.transform(F.filter(options, lambda o: o["correct"]), lambda o: o["label"])
        return d.select(
            F.concat_ws("/", "lang", "source", F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("id"),
            content_hash(parts[0], rest).alias("content_hash"),
            F.struct(
                F.col("lang").alias("slug"),
                F.concat(F.lit("Language "), F.upper("lang"), F.lit(" v"), (F.col("doc_id") % 3).cast("string")).alias("name"),
                F.col("source").alias("vendor"),
                F.when(F.col("quality") == 1, "associate").alias("level"),
            ).alias("certification"),
            F.struct(
                F.when(F.col("n_chars") % 50 != 0, F.col("source")).alias("slug"),
                F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Practice Exam "), F.col("source"))).alias("title"),
                n.alias("number"),
                F.when(n % 3 == 0, "hard").when(n % 3 == 1, "easy").alias("mode"),
                F.col("doc_id").cast("int").alias("question_number"),
            ).alias("exam"),
            F.when(F.col("n_chars") % 41 != 0, domain_label(F.col("n_chars"))).alias("domain"),
            F.when(F.size(correct) > 1, "multi_select").otherwise("single_select").alias("type"),
            F.size(correct).alias("select_count"),
            parts[0].alias("prompt_md"),
            options.alias("options"),
            correct.alias("correct_labels"),
            F.when(F.col("quality").isNotNull(), F.col("text")).alias("overall_explanation_md"),
            F.coalesce("references", F.array().cast("array<string>")).alias("references"),
            F.struct(
                F.col("lang").alias("provider"),
                F.concat(F.lit("https://example.org/"), "lang").alias("course_url"),
                F.concat(F.lit("pages/"), F.col("doc_id").cast("string")).alias("file"),
            ).alias("source"),
            F.when(F.col("quality") == 1, "curated").alias("origin"),
            F.col("doc_id").alias("order_key"),
        )

    # ---- journals
    @property
    def mark(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("question_id"),
            F.col("event_type").alias("value"),
            F.col("ts").alias("created_at"),
        )

    @property
    def attempt(self) -> DataFrame:
        close = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_custkey") % 7200).cast("decimal(18,6)"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("certification_id"),
            F.col("o_orderdate").alias("started_at"),
            F.when(F.col("o_orderstatus") == "F", close).alias("submitted_at"),
            F.when(F.col("o_orderstatus") == "P", close).alias("abandoned_at"),
        )

    @property
    def item(self) -> DataFrame:
        return self._items(self.table("lineitem"))

    @staticmethod
    def _items(lineitem: DataFrame) -> DataFrame:
        raw = lineitem.select(
            "*",
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
            F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        )
        flag = F.col("l_returnflag")
        return raw.select(
            _item_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "cents", "disc", "tax").alias("id"),
            F.col("l_orderkey").alias("attempt_id"),
            F.col("l_linenumber").alias("position"),
            F.col("l_partkey").alias("question_id"),
            F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("first_shown_at"),
            F.when(flag != "N", F.col("l_shipdate")).alias("answered_at"),
            F.when(flag != "N", flag == "R").alias("is_correct"),
            F.when(flag == "R", 1.0).when(flag == "A", -0.25).when(flag == "N", 0.0).alias("credit"),
            (F.col("qty") * 1000).alias("time_ms"),
            "qty",
        )

    @property
    def graded_item(self) -> DataFrame:
        """Items with the snapshot they were asked with: options, key and selection."""
        labels = F.array(*[F.lit(x) for x in "ABCDE"])
        item = self._items(self.table("lineitem")).join(
            self.table("part").select(F.col("p_partkey").alias("question_id"), "p_size", "p_brand"), "question_id"
        )
        options = F.slice(labels, F.lit(1), F.lit(3) + F.col("position") % 3)
        bits = lambda n: F.filter(
            options, lambda label: F.shiftright(n, 1).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(5)]), F.ascii(label) - 64)) > 0
        )
        key = bits(F.col("p_size"))
        return item.select(
            "*",
            options.alias("option_labels"),
            F.when(F.size(key) == 0, F.array(F.lit("A"))).otherwise(key).alias("correct_labels"),
            F.when(F.col("is_correct").isNull(), F.array().cast("array<string>"))
            .when(F.col("is_correct"), F.when(F.size(key) == 0, F.array(F.lit("A"))).otherwise(key))
            .otherwise(bits(F.col("qty").cast("int")))
            .alias("selected_labels"),
        )


# ------------------------------------------------------------------ SQL twins

QUESTION = """question AS (
  SELECT d.doc_id AS id, d.lang AS certification_id, d.source AS exam_slug,
         d.lang || '/' || d.source AS exam_id,
         CASE WHEN d.n_chars < 500 THEN 'Short & sweet' WHEN d.n_chars < 2000 THEN 'Medium, plain'
              WHEN d.n_chars < 8000 THEN 'Long-form' ELSE 'Very long' END AS domain_label,
         d.lang || '/' || CASE WHEN d.n_chars < 500 THEN 'Short & sweet' WHEN d.n_chars < 2000 THEN 'Medium, plain'
              WHEN d.n_chars < 8000 THEN 'Long-form' ELSE 'Very long' END AS domain_id,
         CASE l.toxic WHEN 1 THEN 'multi_select' WHEN 0 THEN 'single_select' END AS type,
         CASE d.lang WHEN 'en' THEN 'vendor_dump' WHEN 'fr' THEN 'official_sample'
              WHEN 'de' THEN 'local_generation' WHEN 'es' THEN 'hand_written' END AS origin,
         d.text AS prompt_md, d.n_chars AS n_chars, l.quality AS quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

EXAM = """exam AS (
  SELECT DISTINCT lang || '/' || source AS id, lang AS certification_id, source AS slug,
         'Exam ' || source AS title,
         CASE TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'easy' END AS mode
  FROM documents)"""

CERTIFICATION = """certification AS (
  SELECT DISTINCT lang AS id, 'Language ' || upper(lang) AS name FROM documents)"""

MARK = """mark AS (
  SELECT event_id AS id, user_id AS question_id, event_type AS value, ts AS created_at FROM events)"""

CURRENT_MARK = (
    MARK
    + """, current_mark AS (
  SELECT question_id, arg_max(value, row(created_at, id)) AS value, max(created_at) AS marked_at
  FROM mark GROUP BY question_id)"""
)

ATTEMPT = """attempt AS (
  SELECT o_orderkey AS id, o_orderpriority AS certification_id, o_orderdate AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_custkey % 7200) END AS submitted_at,
         CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_seconds(o_custkey % 7200) END AS abandoned_at
  FROM orders)"""

ITEM = """item AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT,
                   round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT) AS id,
         l_orderkey AS attempt_id, l_linenumber AS position, l_partkey AS question_id,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS first_shown_at,
         CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS answered_at,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END AS is_correct,
         CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN -0.25::DOUBLE WHEN 'N' THEN 0.0::DOUBLE END AS credit,
         l_quantity::BIGINT * 1000 AS time_ms, l_quantity::BIGINT AS qty
  FROM lineitem)"""

_BITS = "list_filter({options}, lambda x: (({n} >> 1) & (1 << (ascii(x) - 65))) > 0)"

GRADED_ITEM = (
    ITEM
    + """, with_options AS (
  SELECT item.*, p.p_size, p.p_brand, (['A','B','C','D','E'])[1:3 + position % 3] AS option_labels
  FROM item JOIN part p ON p.p_partkey = item.question_id),
keyed AS (
  SELECT *, CASE WHEN len(k) = 0 THEN ['A'] ELSE k END AS correct_labels FROM (
    SELECT *, """
    + _BITS.format(options="option_labels", n="p_size::BIGINT")
    + """ AS k FROM with_options)),
graded_item AS (
  SELECT * EXCLUDE (k), CASE WHEN is_correct IS NULL THEN []::VARCHAR[] WHEN is_correct THEN correct_labels
     ELSE """
    + _BITS.format(options="option_labels", n="qty")
    + """ END AS selected_labels FROM keyed)"""
)

SCOPE = (
    ", ".join([QUESTION, EXAM, CERTIFICATION, CURRENT_MARK])
    + """, scope AS (
  SELECT q.*, c.name AS certification_name, e.title AS exam_title, e.mode AS exam_mode,
         nullif(m.value, 'error') AS mark
  FROM question q LEFT JOIN exam e ON e.id = q.exam_id
  LEFT JOIN certification c ON c.id = q.certification_id
  LEFT JOIN current_mark m ON m.question_id = q.id)"""
)

_PARTS = "string_split(d.text, chr(10))"
_DOMAIN = """CASE WHEN d.n_chars < 500 THEN 'Short & sweet' WHEN d.n_chars < 2000 THEN 'Medium, plain'
              WHEN d.n_chars < 8000 THEN 'Long-form' ELSE 'Very long' END"""
_N = "TRY_CAST(regexp_extract(d.source, '(\\d+)', 1) AS INT)"

CITED = """cite_raw AS (SELECT page_id, [url] || list_transform(list_distinct_ordered, lambda h: 'https://m.example.org/en' || h) AS refs FROM (
    SELECT page_id, url, list_filter(hrefs, lambda h, i: list_position(hrefs, h) = i) AS list_distinct_ordered FROM (
      SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)))"""

RECORD = CITED + f""", record AS (
  SELECT d.doc_id AS n, d.lang || '/' || d.source || '/q' || d.doc_id AS id, d.lang AS cert,
    'Language ' || upper(d.lang) || ' v' || (d.doc_id % 3) AS cert_name, d.source AS vendor,
    CASE WHEN l.quality = 1 THEN 'associate' END AS level,
    CASE WHEN d.n_chars % 50 <> 0 THEN d.source END AS exam_slug,
    CASE WHEN d.doc_id % 2 = 0 THEN 'Practice Exam ' || d.source END AS exam_title,
    {_N} AS exam_number, CASE {_N} % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'easy' END AS exam_mode,
    d.doc_id::INT AS question_number,
    CASE WHEN d.n_chars % 41 <> 0 THEN {_DOMAIN} END AS domain,
    {_PARTS}[1] AS prompt_md, {_PARTS}[2:] AS texts,
    CASE WHEN l.quality IS NOT NULL THEN d.text END AS overall_explanation_md,
    coalesce(c.refs, []) AS refs, d.lang AS provider,
    CASE WHEN l.quality = 1 THEN 'curated' END AS origin_given
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN cite_raw c ON c.page_id = d.doc_id),
option_row AS (
  SELECT id, n, unnest(texts) AS text_md, generate_subscripts(texts, 1) AS pos FROM record),
options_of AS (
  SELECT id AS oid, 'o' || pos AS label, (pos - 1)::INT AS position, text_md, length(text_md) % 3 = 0 AS is_correct,
    CASE WHEN length(text_md) % 2 = 0 THEN text_md END AS explanation_md FROM option_row),
key_of AS (
  SELECT oid, list(label ORDER BY position) FILTER (is_correct) AS correct_labels, count(*) FILTER (is_correct) AS n_correct, count(*) AS n_options
  FROM options_of GROUP BY oid),
full_record AS (
  SELECT r.*, coalesce(k.correct_labels, []) AS correct_labels, coalesce(n_correct, 0) AS n_correct, coalesce(n_options, 0) AS n_options,
    CASE WHEN coalesce(n_correct, 0) > 1 THEN 'multi_select' ELSE 'single_select' END AS type,
    left(sha256(prompt_md || ' ' || array_to_string(list_sort(texts), ' ')), 12) AS content_hash
  FROM record r LEFT JOIN key_of k ON k.oid = r.id)"""


def norm_ref(url: str) -> str:
    """SQL twin of normalize_reference under the test mirror rules."""
    bare = f"regexp_replace(regexp_replace({url}, '^https?://', ''), '/+$', '')"
    path = f"CASE WHEN contains({bare}, '/') THEN regexp_replace({bare}, '^[^/]*/', '') ELSE '' END"
    host = f"split_part({bare}, '/', 1)"
    return (
        f"CASE WHEN starts_with({host}, 'm.') THEN 'docs/' || regexp_replace({path}, '^(?:(?:en|docs)(?:/|$))+', '') "
        f"WHEN starts_with({host}, 'blog.') THEN 'support/' || regexp_replace({path}, '^en/articles/', '') ELSE {bare} END"
    )


CITATION = RECORD + f""", citation AS (
  SELECT question_id, position, raw_url, {norm_ref('raw_url')} AS reference_id, cert, domain FROM (
    SELECT id AS question_id, cert, domain, unnest(refs) AS raw_url, (generate_subscripts(refs, 1) - 1)::INT AS position FROM record))"""

SLUG = "trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"
