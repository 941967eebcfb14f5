"""Outline flattening and its rules, on lines of files of any length and depth.

Parents, ordinals and dotted paths come from blocks of lines and the branch that is open
before each, so a file is never gathered into one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions import blocked
from itemloom.functions import text as tx
from itemloom.schemas import WEIGHT_REGIMES
from itemloom.sources.outlines import INDENT, headers

MAX_DEPTH = 4
BLOCK_LINES = 65536
REQUIRED_HEADERS = ("certification", "vendor", "regime")
WEIGHTED = ("exact", "range")


def _block() -> Column:
    return F.floor(F.col("line_no") / BLOCK_LINES)


def bullets(classified: DataFrame) -> DataFrame:
    rows = classified.where(F.col("kind") == "bullet")
    return rows.withColumn("depth", (F.floor(F.col("spaces") / INDENT) + 1).cast("int")).withColumn(
        "w", tx.weight_fields(F.col("weight_text"))
    )


_ENDS = "file STRING, __block BIGINT, low_depth ARRAY<INT>, low_n ARRAY<BIGINT>, depths ARRAY<INT>, ordinals ARRAY<BIGINT>, children ARRAY<BIGINT>"
_OPEN = "file STRING, __block BIGINT, depths ARRAY<INT>, ordinals ARRAY<BIGINT>, children ARRAY<BIGINT>"
_NODES = "file STRING, line_no BIGINT, depth INT, ordinal BIGINT, path STRING, parent_path STRING, label STRING, weight_text STRING"


def _place(stack: list[list[int]], depth: int) -> None:
    """Open a line below the nearest shallower one; entries are [depth, ordinal, children]."""
    while stack[-1][0] >= depth:
        stack.pop()
    stack[-1][2] += 1
    stack.append([depth, stack[-1][2], 0])


def _columns(stack: list[list[int]]) -> dict[str, list]:
    return {name: [[entry[i] for entry in stack]] for i, name in enumerate(("depths", "ordinals", "children"))}


def _block_ends(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
    """What a block does to any stack: lines by depth that find no parent in it, and what it leaves open."""
    stack: list[list[int]] = [[0, 0, 0]]
    lows: dict[int, int] = {}
    for depth in lines.sort_values("line_no")["depth"].tolist():
        _place(stack, depth)
        if len(stack) == 2:
            lows[depth] = lows.get(depth, 0) + 1
    return pd.DataFrame({"file": [key[0]], "__block": [key[1]], "low_depth": [list(lows)], "low_n": [list(lows.values())], **_columns(stack[1:])})


def _carry(ends: pd.DataFrame) -> pd.DataFrame:
    """The stack that each block of a file starts with."""
    stack, out = [[0, 0, 0]], []
    for block in ends.sort_values("__block").to_dict("records"):
        out.append(pd.DataFrame({"file": [block["file"]], "__block": [block["__block"]], **_columns(stack)}))
        for depth, n in zip(block["low_depth"], block["low_n"]):
            while stack[-1][0] >= depth:
                stack.pop()
            stack[-1][2] += int(n)
        left = [list(map(int, entry)) for entry in zip(block["depths"], block["ordinals"], block["children"])]
        left[0][1] = stack[-1][2]  # the last line without a parent in the block
        stack += left
    return pd.concat(out)


def _number(lines: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    start = before.iloc[0]
    stack = [list(map(int, entry)) for entry in zip(start["depths"], start["ordinals"], start["children"])]
    lines = lines.sort_values("line_no")
    ordinals, paths, parents = [], [], []
    for depth in lines["depth"].tolist():
        _place(stack, depth)
        chain = [str(entry[1]) for entry in stack[1:]]
        ordinals.append(stack[-1][1])
        paths.append(".".join(chain))
        parents.append(".".join(chain[:-1]) or None)
    return lines.assign(ordinal=ordinals, path=paths, parent_path=parents)[[c.split()[0] for c in _NODES.split(", ")]]


def flatten(classified: DataFrame) -> DataFrame:
    """Bullets with depth, ordinal among siblings, dotted path, parent path and weights.

    A bullet's parent is the nearest earlier line that is shallower, at any depth.  A block
    of lines is reduced to the lines without a parent in it and its open branch; these few
    rows are scanned in file order, and each block numbers its lines from the branch that is
    open before it.  ``refused_lines`` names the bullets that break the outline's rules.
    """
    rows = bullets(classified).select("file", F.col("line_no").cast("bigint").alias("line_no"), "depth", "label", "weight_text")
    rows = rows.withColumn("__block", _block())
    keys = ["file", "__block"]
    ends = rows.select(*keys, "line_no", "depth").groupBy(*keys).applyInPandas(_block_ends, _ENDS)
    before = ends.groupBy("file").applyInPandas(_carry, _OPEN)
    nodes = rows.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(_number, _NODES)
    return nodes.select("*", tx.weight_fields(F.col("weight_text")).alias("w")).select(
        "file", "line_no", "depth", "ordinal", "path", "parent_path", "label", "w.*"
    )


def _stepped(rows: DataFrame) -> DataFrame:
    return blocked.lag(rows, ["file"], _block(), [F.col("line_no")], F.col("depth"), "before")


def _misplaced() -> list[Column]:
    return [
        F.when(F.col("spaces") % INDENT != 0, f"indent is not a multiple of {INDENT}"),
        F.when(F.col("depth") > MAX_DEPTH, f"deeper than {MAX_DEPTH}"),
        F.when(F.col("depth") > F.coalesce("before", F.lit(0)) + 1, "no parent"),
    ]


def refused_lines(classified: DataFrame) -> DataFrame:
    """Bullets whose place breaks a rule, a row for each rule: (file, line_no, depth, label, problem)."""
    rules = F.array_compact(F.array(*_misplaced()))
    return _stepped(bullets(classified)).select("file", "line_no", "depth", "label", F.explode(rules).alias("problem"))


def with_kinds(nodes: DataFrame, classified: DataFrame) -> DataFrame:
    """Name each depth the way the file's ``levels`` header does."""
    levels = (
        headers(classified)
        .where(F.col("key") == "levels")
        .select("file", F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "").alias("__levels"))
    )
    return nodes.join(levels, "file", "left").withColumn("kind", F.get("__levels", F.col("depth") - 1)).drop("__levels")


def weight_summary(nodes: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per file: sum of exact weights or range lows, sum of highs, and whether exact is 100."""
    top = nodes.where(F.col("depth") == 1).groupBy("file").agg(
        F.sum(F.coalesce("weight_pct", F.lit(0.0))).alias("exact"),
        F.sum(F.coalesce("weight_min", F.lit(0.0))).alias("low"),
        F.sum(F.coalesce("weight_max", F.lit(0.0))).alias("high"),
    )
    r = F.col("regime")
    total = F.when(r == "exact", F.round("exact", 4)).when(r == "range", F.round("low", 4))
    return regimes.join(top, "file").select(
        "file",
        "regime",
        total.alias("weights_sum"),
        F.when(r == "range", F.round("high", 4)).alias("weights_sum_max"),
        F.when(r == "exact", F.abs(total - 100.0) < 1e-6).alias("weights_sum_to_100"),
    )


def regimes(classified: DataFrame) -> DataFrame:
    return headers(classified).where(F.col("key") == "regime").select("file", F.col("value").alias("regime"))


def outline_problems(classified: DataFrame) -> DataFrame:
    """(file, line_no, problem) for every broken outline rule."""
    rows = bullets(classified)
    firsts = rows.groupBy("file").agg(F.min("line_no").alias("first_bullet"))
    stepped = _stepped(rows)
    w, text = F.col("w"), F.col("weight_text")
    no_weight = w["weight_pct"].isNull() & w["weight_min"].isNull()

    def problems(df: DataFrame, *tests: Column) -> DataFrame:
        return df.select("file", "line_no", F.explode(F.array_compact(F.array(*tests))).alias("problem"))

    per_bullet = problems(
        stepped,
        *_misplaced(),
        F.when(F.trim("label") == "", "no label"),
        F.when(text.isNotNull() & (F.col("depth") > 1), "weight below the top level"),
        F.when(text.isNotNull() & no_weight, "not a weight"),
        F.when(w["weight_min"] > w["weight_max"], "range runs backwards"),
    )
    top = (
        rows.where(F.col("depth") == 1)
        .join(regimes(classified), "file")
        .select("file", "line_no", "regime", w["weight_pct"].isNotNull().alias("exact"), w["weight_min"].isNotNull().alias("range"))
    )
    weighted = F.col("exact") | F.col("range")
    per_top = problems(
        top,
        F.when(F.col("regime").isin(*WEIGHTED) & ~weighted, "weight missing for the regime"),
        F.when(
            weighted & (((F.col("regime") == "exact") & F.col("range")) | ((F.col("regime") == "range") & F.col("exact"))),
            "weight of the wrong shape",
        ),
        F.when(~F.col("regime").isin(*WEIGHTED) & weighted, "regime carries no weights"),
    )
    heads = classified.where(F.col("kind") != "bullet").join(firsts, "file", "left")
    late = F.col("line_no") > F.col("first_bullet")
    source = tx.source_fields(F.col("value"))
    is_source = ~late & (F.col("key") == "source")
    per_head = problems(
        heads.withColumn("late", F.coalesce(late, F.lit(False))),
        F.when(F.col("late"), "expected a bullet"),
        F.when(~F.col("late") & (F.col("kind") == "other"), "expected a header or bullet"),
        F.when(is_source & source["path"].isNull(), "source needs a path"),
        F.when(is_source & ~F.coalesce(source["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "source needs sha256"),
    )
    keyed = classified.where((F.col("kind") == "header") & (F.col("key") != "source"))
    twice = (
        keyed.groupBy("file", "key")
        .agg(F.max("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("file", "line_no", F.concat(F.lit("set twice: "), "key").alias("problem"))
    )
    facts = classified.groupBy("file").agg(
        *[F.max(F.coalesce((F.col("kind") == "header") & (F.col("key") == k), F.lit(False))).alias(f"has_{k}") for k in REQUIRED_HEADERS],
        F.max(F.col("kind") == "bullet").alias("has_bullets"),
        F.max(F.when((F.col("kind") == "header") & (F.col("key") == "regime"), F.col("value"))).alias("regime"),
        F.max(F.when((F.col("kind") == "header") & (F.col("key") == "levels"), F.size(F.filter(F.split("value", ","), lambda x: F.trim(x) != "")))).alias("levels"),
        F.max(F.when(F.col("kind") == "bullet", F.floor(F.col("spaces") / INDENT) + 1)).alias("deepest"),
    )
    per_file = problems(
        facts.withColumn("line_no", F.lit(1).cast("bigint")),
        *[F.when(~F.col(f"has_{k}"), f"missing header: {k}") for k in REQUIRED_HEADERS],
        F.when(~F.col("regime").isin(*WEIGHT_REGIMES), "unknown regime"),
        F.when(~F.col("has_bullets"), "no nodes"),
        F.when((F.col("levels") > 0) & (F.col("levels") < F.col("deepest")), "too few level names"),
    )
    return reduce(DataFrame.unionByName, [per_bullet, per_top, per_head, twice, per_file])


def source_drift(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Recorded digests that differ from a present file; an absent file is no error."""
    now = present.select("path", F.col("sha256").alias("found"))
    return recorded.join(now, "path").where(F.col("sha256") != F.col("found"))
