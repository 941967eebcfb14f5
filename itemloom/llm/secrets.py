"""Secret scans over an incremental ledger of text blobs, in DataFrame operations only.

Every version of every path is content-addressed: its text's SHA-256 is its blob.  The
ledger, a Parquet table in a folder the caller names, has a row for each blob and rule
version that was scanned, with its findings.  A scan looks only at pairs the ledger lacks,
each blob once however many paths and versions hold it, appends their findings, and joins
the ledger back to all paths.

Spans come from splitting: the pieces between matches and the matches, both from one
pattern and engine, alternate through the text, so running sums of their lengths are the
positions in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from itemloom.llm.shared import whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose group ``group`` has at least ``least`` characters; ``hint`` is in every match."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: Fixed values, the base kinds in the order of the report.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, r"(?i)(?:pass|secret|token|api)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
)
#: Kinds this scan adds to the base.
ADDED = (Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, "-----BEGIN "),)
RULES = (*BASE, *ADDED)
RULE_VERSION = "base-3+pem"

#: Copies of a found blob's row, so that a blob which many paths hold joins in parts.
SALTS = 16

LEDGER = "blob string, rule_version string, findings array<struct<start: bigint, ordinal: int, kind: string, end: bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _cuts(ordinal: int, rule: Rule) -> Column:
    """The rule's pieces and matches of ``text``, in order; the piece after the last match has no length."""
    hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("a"), hits.alias("b"), counted.alias("c"))

    def cut(x: Column, place: Column) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            place.alias("place"),
            F.length(x["a"]).alias("gap"),
            F.length(x["b"]).alias("length"),
            (F.length(x["c"]) >= rule.least).alias("kept"),
        )

    none = F.array().cast("array<struct<ordinal: int, place: int, gap: int, length: int, kept: boolean>>")
    return F.when(F.col("text").rlike(rule.hint), F.transform(zipped, cut)).otherwise(none)


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and findings of every text (blob, text): one pass over the texts.

    Each rule cuts a text that passes its hint; the cuts become rows, and a running sum
    over a blob's rows of one rule gives the places, so a text of any length and number of
    matches costs in proportion to them.  With texts already dealt by blob, nothing moves.
    """
    per_rule = [_cuts(ordinal, rule) for ordinal, rule in enumerate(rules)]
    rows = blobs.select("blob", F.explode_outer(F.flatten(F.array(*per_rule))).alias("cut")).select("blob", "cut.*")
    upto = Window.partitionBy("blob", "ordinal").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("bigint")).over(upto))
    kind = F.element_at(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("ordinal") + 1)
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "ordinal", kind.alias("kind"), "end")
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("kept"), span))).alias("findings"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; none where nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> None:
    """Scan the blobs of ``versions`` (column ``text``) that ``rule_version`` has not seen, and add them to the ledger."""
    seen = ledger(versions.sparkSession, folder).filter(F.col("rule_version") == rule_version).select("blob").distinct()
    texts = versions.select(whole_text().alias("text")).withColumn("blob", blob_of(F.col("text")))
    unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
    # Blobs without findings stand in the ledger too: they need no second scan.
    rows = findings(unseen, rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings")
    rows.write.mode("append").parquet(f"{folder}/ledger")


def joined(versions: DataFrame, folder: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """All rows and columns of ``versions`` with ``__findings``, null where the text has none."""
    known = ledger(versions.sparkSession, folder).filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0))
    copies = known.groupBy("blob").agg(F.first("findings").alias("__findings")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = versions.withColumn("__blob", blob_of(whole_text())).withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return keyed.join(copies.withColumnRenamed("blob", "__blob"), ["__blob", "__salt"], "left").drop("__blob", "__salt")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def scan(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Update the ledger in ``folder`` and return doc_id, the base counts, base_sha256 and spans of every row.

    A null text counts as empty and has no findings; a null doc_id stays; repeated rows and
    equal texts have equal findings; an empty table gives no rows; other columns are not
    read.  ``spans`` lists all kinds by start, then kind; ``base_sha256`` digests the base kinds.
    """
    update(versions, folder, rules, rule_version)
    rows = joined(versions.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), folder, rule_version)
    all_ = F.coalesce("__findings", F.expr("array()").cast("array<struct<start: bigint, ordinal: int, kind: string, end: bigint>>"))
    base = F.filter(all_, lambda f: f["ordinal"] < len(BASE))

    def count(ordinal: int) -> Column:
        return F.size(F.filter(all_, lambda f: f["ordinal"] == ordinal)).cast("bigint")

    counts = [count(ordinal).alias(f"n_{rule.kind}") for ordinal, rule in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(all_).alias("spans"))


def redacted(documents: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """The rows with each found span replaced by ``[kind]``; spans that overlap are one, named by the first.

    All columns stay; n_chars, where there is one, is the new text's length.
    """
    update(documents, folder, rules, rule_version)
    names = documents.columns
    rows = joined(documents, folder, rule_version)
    # Kept text between merged spans: a fold over the spans in order, that carries the end so far.
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))

    def step(done: Column, f: Column) -> Column:
        gap = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (f["start"] - done["at"]).cast("int"))
        fresh = F.concat(done["parts"], F.array(gap, F.concat(F.lit("["), f["kind"], F.lit("]"))))
        return F.struct(F.when(f["start"] >= done["at"], fresh).otherwise(done["parts"]).alias("parts"), F.greatest(done["at"], f["end"]).alias("at"))

    cut = F.aggregate(F.col("__findings"), start, step, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(F.col("text"), (d["at"] + 1).cast("int"), F.length("text"))))
    rows = rows.withColumn("__text", F.when(F.col("__findings").isNull(), F.col("text")).otherwise(cut))
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__findings").isNull(), F.col("n_chars") if "n_chars" in names else None).otherwise(F.length("__text").cast("bigint"))}
    return rows.select(*[new.get(n, F.col(f"`{n}`")).alias(n) for n in names])


def _sql() -> str:
    """The base kinds as DuckDB SQL over ``documents``; the added kind by its own pattern."""

    def either_case(pattern: str) -> str:
        head, tail = pattern.removeprefix("(?i)").split(")", 1)
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail

    parts = []
    for ordinal, rule in enumerate(RULES):
        pattern = (either_case(rule.pattern) if rule.pattern.startswith("(?i)") else rule.pattern).replace("'", "''")
        parts.append(
            f"SELECT rid, {ordinal} AS ordinal, '{rule.kind}' AS kind, {rule.least} AS least, unnest(range(1, 2 + len(regexp_extract_all(text, '{pattern}')))) AS place, "
            f"unnest(string_split_regex(text, '{pattern}')) AS gap, unnest(regexp_extract_all(text, '{pattern}', 0)) AS hit, "
            f"unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS counted FROM d"
        )
    counts = ", ".join(f"count(*) FILTER (ordinal = {k}) AS n_{rule.kind}" for k, rule in enumerate(BASE))
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ordinal){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cuts AS ({" UNION ALL ".join(parts)}),
ends AS (
  SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, ordinal ORDER BY place) AS BIGINT) AS stop
  FROM cuts WHERE hit IS NOT NULL
),
spans AS (SELECT rid, ordinal, kind, stop - length(hit) AS start, stop FROM ends WHERE length(counted) >= least)
SELECT doc_id, {counts}, sha256({listed.format(f" FILTER (ordinal < {len(BASE)})")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""


ORACLE = _sql()
