"""A Merkle manifest of a dataset: a root digest, and proofs of leaves found by descent.

Leaves are digests of rows.  The leaves of a language, in order of doc_id, make a binary
tree; the trees' roots, in order of language, make the tree on top.  A tree is cut into
blocks of ``BITS`` levels.  The store has a record for each block, addressed by the digest
of its top: the children of every node in it, level by level.

Requests go down from the root together.  A row stands for all requests below one node;
at a block it follows the binary digits of their ranks, collects the child that each digit
leaves out, and parts where their digits part, so rows grow to one a block of leaves and
no digest is asked for by more rows than blocks have it.  Reversed, the collected segments
are the siblings from the leaf up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from itemloom.llm.shared import crc32_sql

#: Levels of a block: 1,024 children at its bottom, about 130 KB of digests.
BITS = 10
#: The columns that a leaf digests, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree on top of all languages' trees.
TOP = "top"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's values: ``-`` for a null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def leaves(documents: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf and claimed of every row: the digest of the row, and that of the row with ``changed`` columns ``where`` that holds."""
    kept = documents.select(*[F.col(c) for c in LEAF_COLUMNS])
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    own = kept.withColumn("leaf", leaf_digest(*values.values()))
    claimed = F.col("leaf") if where is None else F.when(where, leaf_digest(*(values | (changed or {})).values())).otherwise(F.col("leaf"))
    # Bytewise order of languages with the null one first; the sign keeps an empty name apart from it.
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return own.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), "leaf", claimed.alias("claimed"))


def _ranked(rows: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """The rows with their rank in their tree and its count ``n``: a range sort, and running sums over its partitions' counts.

    Rows that are equal in everything are spread by their place in the input.  The sorted
    rows are a table at ``path``, so every reader sees one and the same partitioning.
    """
    placed = rows.withColumn("spread", F.monotonically_increasing_id())
    keys = ["tree", *order, "spread"]
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*rows.columns, F.spark_partition_id().alias("part"), inside.alias("place"))
    cut.write.parquet(path)
    cut = rows.sparkSession.read.schema(cut.schema).parquet(path)
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    bases = pieces.select("tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("size").over(of_tree).alias("n"))
    return cut.join(bases, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("base")).drop("part", "place", "base")


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes: the binary digits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _levels(nodes: Column, height: Column) -> Column:
    """The nodes, their parents, and so on for ``height`` levels."""

    def parents(below: Column) -> Column:
        pair = lambda i: digest(F.concat(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))))
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)), pair)

    return F.aggregate(F.array_repeat(F.lit(0), height), F.array(nodes), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))


def _stripes(most: int) -> int:
    """Blocks on the way from a leaf to the root of a tree of ``most`` leaves."""
    return max(1, -(-(most - 1).bit_length() // BITS))


def _blocks(members: DataFrame, path: str) -> DataFrame:
    """Write the records over grouped children (tree, place, n, digests); return their tops as nodes."""
    levels = _levels(F.col("digests"), F.least(F.lit(BITS), _height(F.col("n"))))
    rows = members.select("tree", "place", "n", levels.alias("levels"))
    rows.withColumn("digest", F.element_at(F.element_at("levels", -1), 1)).write.parquet(path)
    tops = members.sparkSession.read.parquet(path)
    return tops.select("tree", F.col("place").alias("rank"), F.shiftright(F.col("n") + (1 << BITS) - 1, BITS).alias("n"), "digest")


def _grouped(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, rank, n, digest and others), those of a block together in order of rank."""
    rest = [c for c in nodes.columns if c not in ("tree", "rank", "n")]
    rows = nodes.groupBy("tree", F.shiftright("rank", BITS).alias("place"), "n").agg(F.sort_array(F.collect_list(F.struct("rank", *rest))).alias("members"))
    return rows.withColumn("digests", F.col("members.digest"))


def _grow(members: DataFrame, most: int, folder: str) -> DataFrame:
    """Write a record for every block of every stripe; return the trees' roots (tree, digest)."""
    for stripe in range(_stripes(most)):
        tops = _blocks(members, f"{folder}/{stripe}")
        members = _grouped(tops)
    return tops.select("tree", "digest")


def build(rows: DataFrame, folder: str) -> None:
    """Write the store of the rows of ``leaves`` to ``folder``: members by block, records by stripe, the trees' ranks.

    The text of the rows is read once and only its digests move.  Equal doc_ids stand in
    the order of their digests, a null one first.  No rows make an empty store.
    """
    spark = rows.sparkSession
    ranked = _ranked(rows.withColumnRenamed("leaf", "digest"), ["doc_id", "digest"], f"{folder}/sorted")
    _grouped(ranked).drop("digests").write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members").withColumn("digests", F.col("members.digest"))
    most = members.agg(F.max("n")).first()[0]
    if most is None:
        return
    roots = _grow(members, most, f"{folder}/trees")
    # The tree on top: its leaves are the roots, its only tree is TOP.
    on_top = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    _ranked(on_top, ["name"], f"{folder}/names").write.parquet(f"{folder}/top-nodes")
    nodes = spark.read.parquet(f"{folder}/top-nodes")
    _grow(_grouped(nodes), nodes.agg(F.max("n")).first()[0], f"{folder}/top")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """digest and levels: equal blocks are one record."""
    return spark.read.parquet(path).groupBy("digest").agg(F.first("levels").alias("levels"))


def _left_out(place: Column, levels: Column) -> Column:
    """The children that the binary digits of ``place`` leave out in a block, from its top down; null where there is none."""
    height = F.size(levels) - 1

    def step(_: Column, down: Column) -> Column:
        level = height - 1 - down
        at = F.call_function("shiftright", place, level)
        other = at.bitwiseXOR(F.lit(1))
        return F.struct((other < at).alias("left"), F.get(F.get(levels, level), other).alias("digest"))

    return F.transform(F.array_repeat(F.lit(0), height), step)


def _descend(front: DataFrame, records: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Rows (tree, place, digest, path) one stripe further down, a row a child."""
    met = front.join(records, "digest")

    def child(below: Column, i: Column) -> Column:
        return F.struct((F.col("place") * (1 << BITS) + i).alias("place"), below.alias("digest"), F.concat("path", _left_out(i, F.col("levels"))).alias("path"))

    return met.select("tree", *carried, F.inline(F.transform(F.get("levels", F.lit(0)), child)))


def _stripe_count(spark: SparkSession, folder: str) -> int:
    """Stripes written below ``folder``: their number follows from the largest tree, so they are tried in turn."""
    count = 0
    while True:
        try:
            spark.read.parquet(f"{folder}/{count}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return count
        count += 1


def proofs(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """tree, rank, doc_id, leaf, claimed, subroot, root and siblings, from the leaf up, of the requested leaves.

    ``wanted`` has tree and rank of the requests; without it every leaf of the store is one.
    A sibling is (left, digest), its digest null where a run had one node.
    """
    found = "tree string, rank bigint, doc_id bigint, leaf string, claimed string, subroot string, root string, siblings array<struct<left: boolean, digest: string>>"
    top, trees = _stripe_count(spark, f"{folder}/top"), _stripe_count(spark, f"{folder}/trees")
    if not top:
        return spark.createDataFrame([], found)

    def asked(front: DataFrame, stripe: int) -> DataFrame:
        if wanted is None:
            return front
        return front.join(wanted.select("tree", F.shiftright("rank", BITS * (stripe + 1)).alias("place")).distinct(), ["tree", "place"], "left_semi")

    nothing = F.array().cast("array<struct<left: boolean, digest: string>>")
    front = spark.read.parquet(f"{folder}/top/{top - 1}").select("tree", F.lit(0).cast("bigint").alias("place"), "digest", nothing.alias("path"), F.col("digest").alias("root"))
    for stripe in reversed(range(top)):
        front = _descend(front, _records(spark, f"{folder}/top/{stripe}"), ["root"])
    names = spark.read.parquet(f"{folder}/top-nodes").select(F.col("rank").alias("place"), "name")
    front = front.join(names, "place").select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("place"), "digest", "path", "root", F.col("digest").alias("subroot"))
    for stripe in reversed(range(1, trees)):
        front = _descend(asked(front, stripe), _records(spark, f"{folder}/trees/{stripe}"), ["root", "subroot"])
    met = asked(front, 0).join(_records(spark, f"{folder}/trees/0"), "digest")
    met = met.join(spark.read.parquet(f"{folder}/members"), ["tree", "place"])

    def proof(m: Column) -> Column:
        path = F.concat("path", _left_out(m["rank"].bitwiseAND((1 << BITS) - 1), F.col("levels")))
        return F.struct(m["rank"].alias("rank"), m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"), m["claimed"].alias("claimed"), F.reverse(path).alias("siblings"))

    rows = met.select("tree", "subroot", "root", F.inline(F.transform("members", proof)))
    rows = rows if wanted is None else rows.join(wanted.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")
    return rows.select(*[c.split()[0] for c in found.replace("struct<left: boolean, ", "").split(", ")])


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(below: Column, s: Column) -> Column:
        pair = F.when(s["digest"].isNull(), below).when(s["left"], F.concat(s["digest"], below)).otherwise(F.concat(below, s["digest"]))
        return digest(pair)

    return F.aggregate(siblings, leaf, up)


def audit(documents: DataFrame, folder: str, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Build the manifest of ``documents`` in ``folder`` and prove every row, as it is or as ``changed`` says, against its root.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root and
    verified.  Any column may be null; empty and long texts are digested whole; equal rows
    are leaves of their own with equal digests; an empty table gives no rows; other columns,
    whatever their names, are not read.  A null doc_id stands first in its tree.
    """
    build(leaves(documents, changed, where), folder)
    rows = proofs(documents.sparkSession, folder)
    siblings = F.array_join(F.transform("siblings", lambda s: F.coalesce(s["digest"], F.lit(""))), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.col("claimed"), F.col("siblings")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Rows whose claimed leaf differs in the audit: unsigned crc32 of doc_id is a multiple of this.
TAMPERED_EVERY = 7


def tampered_audit(documents: DataFrame, folder: str) -> DataFrame:
    """``audit`` with one more in n_chars where ``TAMPERED_EVERY`` divides crc32 of doc_id; a null doc_id or n_chars stays."""
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return audit(documents, folder, {"n_chars": F.col("n_chars") + 1}, F.coalesce(where, F.lit(False)))


def _sql() -> str:
    def leaf(n_chars: str) -> str:
        values = (n_chars if c == "n_chars" else c for c in LEAF_COLUMNS)
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"

    def grown(name: str, base: str) -> str:
        return f"""{name} AS (
  {base}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (width + 1) // 2
  FROM {name} WHERE width > 1 GROUP BY tree, level, width, pos // 2
)"""

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED_EVERY} = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS claimed
  FROM documents
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM d
),
{grown("low", "SELECT tree, 0 AS level, rank AS pos, leaf AS h, n AS width FROM r")},
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n, level AS height FROM low WHERE width = 1),
{grown("high", "SELECT '' AS tree, 0 AS level, rank AS pos, subroot AS h, n AS width FROM subroots")},
top AS (SELECT h AS root, level AS height FROM high WHERE width = 1),
path AS (
  SELECT r.tree, r.rank, k AS step, (r.rank >> k) & 1 AS odd, low.h
  FROM r JOIN subroots s USING (tree), unnest(range(s.height)) u(k)
  LEFT JOIN low ON low.tree = r.tree AND low.level = k AND low.pos = xor(r.rank >> k, 1)
  UNION ALL
  SELECT r.tree, r.rank, s.height + k, (s.rank >> k) & 1, high.h
  FROM r JOIN subroots s USING (tree), top, unnest(range(top.height)) u(k)
  LEFT JOIN high ON high.level = k AND high.pos = xor(s.rank >> k, 1)
),
fold AS (
  SELECT tree, rank, 0 AS step, claimed AS h FROM r
  UNION ALL
  SELECT f.tree, f.rank, f.step + 1, sha256(CASE WHEN p.odd = 1 THEN coalesce(p.h, '') || f.h ELSE f.h || coalesce(p.h, '') END)
  FROM fold f JOIN path p ON p.tree = f.tree AND p.rank = f.rank AND p.step = f.step
),
ends AS (SELECT tree, rank, max_by(h, step) AS folded_root FROM fold GROUP BY tree, rank),
proof AS (SELECT tree, rank, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM path GROUP BY tree, rank)
SELECT r.doc_id, r.leaf, s.subroot, top.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM r JOIN subroots s USING (tree) JOIN ends e ON e.tree = r.tree AND e.rank = r.rank LEFT JOIN proof p ON p.tree = r.tree AND p.rank = r.rank, top
"""


ORACLE = _sql()
