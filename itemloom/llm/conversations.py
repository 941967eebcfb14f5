"""Repair of conversation structure by a Viterbi search whose paths are given out as they settle.

A conversation's rows, in order, are edited so that its roles' initials read: an ``s`` or
none, then ``ua`` any number of times.  The search keeps the cheapest path to each of four
states.  Paths are chains of nodes that point back, shared where they agree; a node counts
what refers to it and goes when nothing does.  Once all surviving paths pass one node, the
edits up to it are settled: they are given out and forgotten.  So memory holds the part of
a conversation on which survivors still differ.  (Where its last row decides on its first,
as with no role but foreign ones, that is all of it, in any exact search.)

Equal costs are decided by the unsettled edits of both paths, all of them.  Every insertion
belongs to the row after it, so no path over the same rows begins another, and the lesser
of two stays the lesser whatever follows: the order of the survivors' unsettled edits is
kept from row to row, and a tie costs one look at it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, crc32_sql

#: What the edits cost, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row; the ends are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where a role's initial leads from each state; no entry, no way.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Damage by remainder of crc32 of ``conv_id:turn``.
DAMAGES = 20
VISIBLE = r"[^\x20\x09-\x0D]"

EDITED = "conv_id bigint, place bigint, edit string, role string, text string"
SUMMARY = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Row(NamedTuple):
    role: str
    text: str
    fault: str


class Node:
    """An edit on a path; ``down`` are the nodes that go on from it, ``held`` counts them and the survivor that ends here."""

    __slots__ = ("above", "depth", "down", "held", "edit", "role", "text")

    def __init__(self, above: Node | None, edit: str, role: str | None, text: str | None):
        self.above, self.edit, self.role, self.text = above, edit, role, text
        self.depth = above.depth + 1 if above else 0
        self.down: list[Node] = []
        self.held = 0
        if above:
            above.down.append(self)
            above.held += 1


def _release(node: Node) -> None:
    """Let go of a path's end, and of what nothing else refers to above it."""
    node.held -= 1
    while not node.held and node.above:
        above = node.above
        above.down.remove(node)
        above.held -= 1
        node = above


#: (state, insertions, state after them): no more than two, since a third comes back to a state.
_INSERTIONS = [(s, 0, s) for s in range(4)] + [(START, 1, USER), (SYSTEM, 1, USER), (USER, 1, ASSISTANT), (ASSISTANT, 1, USER), (START, 2, ASSISTANT), (SYSTEM, 2, ASSISTANT)]


def _moves(row: Row) -> Iterator[tuple[int, int, str, int]]:
    """(state, cost, edit, state after it) of a row itself."""
    for state in range(4):
        yield state, DELETE, "D", state
    if row.fault in ("blank", "duplicate"):
        return
    extra = TRUNCATED if row.fault == "truncated" else 0
    for state, after in STEPS.get(row.role[:1], {}).items():
        yield state, KEEP + extra, "K", after
    for initial in "ua":
        for state, after in STEPS[initial].items():
            yield state, REROLE + extra, "R", after


class Search:
    """Feed rows with ``add``, then ``end``: both give out settled nodes; then ``cost`` is known."""

    def __init__(self):
        self._root = Node(None, "", None, None)
        self._root.held = 1
        #: By state: cost, the path's end, and its place in the order of the survivors' unsettled edits.
        self._alive: dict[int, tuple[int, Node, int]] = {START: (0, self._root, 0)}
        self.cost = 0

    def add(self, row: Row) -> Iterator[Node]:
        best: dict[int, tuple] = {}
        moves = list(_moves(row))
        for first, count, between in _INSERTIONS:
            if first not in self._alive:
                continue
            spent, node, order = self._alive[first]
            for state, cost, edit, after in moves:
                if state == between:
                    option = (spent + INSERT * count + cost, order, "I" * count + edit, between, node)
                    if after not in best or option[:3] < best[after][:3]:
                        best[after] = option
        fresh = {}
        kept = sorted(self._worthwhile(best).items(), key=lambda item: item[1][1:3])
        for order, (after, (cost, _, edits, between, node)) in enumerate(kept):
            node = self._inserted(node, len(edits) - 1, between)
            edit = edits[-1]
            role = None if edit == "D" else row.role if edit == "K" else ROLES[after]
            node = Node(node, edit, role, None if edit == "D" else row.text)
            node.held += 1
            fresh[after] = (cost, node, order)
        return self._next(fresh)

    @staticmethod
    def _worthwhile(best: dict[int, tuple]) -> dict[int, tuple]:
        """Without states from which every way on is dearer than one from elsewhere, so that no path that leads nowhere stays.

        What follows START or SYSTEM may follow ASSISTANT as well, but for a system row, which
        would have to go; one insertion leads from USER to ASSISTANT and back.
        """
        costs = {state: option[0] for state, option in best.items()}
        never = float("inf")
        user, assistant = costs.get(USER, never), costs.get(ASSISTANT, never)
        most = {ASSISTANT: user + INSERT, USER: assistant + INSERT}
        most[SYSTEM] = min(assistant, user + INSERT)
        most[START] = most[SYSTEM] + DELETE
        return {state: option for state, option in best.items() if costs[state] <= most[state]}

    @staticmethod
    def _inserted(node: Node, count: int, last: int) -> Node:
        """The insertions that lead to state ``last``."""
        for k in range(count):
            role = last if (count - 1 - k) % 2 == 0 else USER + ASSISTANT - last
            node = Node(node, "I", ROLES[role], "")
        return node

    def _next(self, fresh: dict[int, tuple[int, Node, int]]) -> Iterator[Node]:
        before, self._alive = self._alive, fresh
        for _, node, _ in before.values():
            _release(node)
        # All survivors lie below the root: while it leads to one node alone, they pass it.
        while len(self._root.down) == 1 and self._root.held == 1:
            settled = self._root.down[0]
            settled.above = None
            self._root = settled
            yield settled

    def unsettled(self) -> int:
        count, nodes = 0, list(self._root.down)
        while nodes:
            node = nodes.pop()
            count += 1
            nodes += node.down
        return count

    def end(self) -> Iterator[Node]:
        """The rest of the cheapest path that ends well."""
        options = [
            (cost + INSERT * count, order, "I" * count, last, node)
            for first, count, last in _INSERTIONS
            if last in ENDS
            for cost, node, order in ([self._alive[first]] if first in self._alive else [])
        ]
        self.cost, _, edits, last, node = min(options, key=lambda option: option[:3])
        node = self._inserted(node, len(edits), last)
        node.held += 1
        yield from self._next({last: (self.cost, node, 0)})


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, seen (earlier in the conversation), blank and truncated of each distinct row.

    Equal rows of a turn are one row with a count, so a row that is repeated without end is
    summed before it moves.  A conversation's rows come to one partition, where a number in
    order of turn tells whether a role and text came earlier.  A null role or text counts as
    a blank; null turns come first.
    """
    blank = F.lit(" ")
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    once = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    placed = once.repartition("conv_id").withColumn("same", same)
    ending = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    return placed.select(
        "conv_id", "turn", "role", "text", "copies",
        (F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("turn")) > 1).alias("seen"),
        (~F.col("text").rlike(VISIBLE)).alias("blank"), (~ending.isin(".", "!", "?")).alias("truncated"),
    )


def _streams(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int | None, Iterator[Row]]]:
    """The conversations of a sorted partition, each as a stream of its rows, every copy of a row a row."""

    def rows() -> Iterator[tuple[int | None, Row]]:
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["conv_id"]]
            for i, role, text, copies, seen, blank, cut in zip(ids, *(batch[c].tolist() for c in "role text copies seen blank truncated".split())):
                for k in range(copies):
                    yield i, Row(role, text, "blank" if blank else "duplicate" if seen or k else "truncated" if cut else "")

    for conv_id, members in groupby(rows(), key=lambda r: (r[0] is None, r[0])):
        yield conv_id[1], (row for _, row in members)


def _searched(rows: Iterable[Row], search: Search) -> Iterator[Node]:
    for row in rows:
        yield from search.add(row)
    yield from search.end()


def _edited(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in EDITED.split(", ")]
    out: list[tuple] = []
    size = 0
    for conv_id, rows in _streams(batches):
        for place, node in enumerate(_searched(rows, Search())):
            out.append((conv_id, place, node.edit, node.role, node.text))
            size += len(node.text or "")
            if len(out) >= 2000 or size >= 4 << 20:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out, size = [], 0
    yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})


class _Counts:
    """Fault counts of rows that pass by."""

    def __init__(self):
        self.of = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self._before: str | None = None

    def seen(self, rows: Iterable[Row]) -> Iterator[Row]:
        for row in rows:
            if row.fault:
                self.of[row.fault] += 1
            initial = row.role[:1]
            if self._before is not None and self._before + initial not in ("su", "ua", "au"):
                self.of["illegal"] += 1
            self._before = initial
            yield row


def _summaries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    out = []
    for conv_id, rows in _streams(batches):
        counts, search = _Counts(), Search()
        audit, text, glue = [], hashlib.sha256(), b""
        for node in _searched(counts.seen(rows), search):
            audit.append(node.edit)
            if node.role is not None:
                text.update(glue + f"{node.role}:{node.text}".encode())
                glue = b"\n"
        out.append((conv_id, *counts.of.values(), search.cost, "".join(audit), text.hexdigest()))
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
            out = []
    yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with faults, a conversation in one partition, in order of turn, then role and text."""
    bounded_batches(rows.sparkSession)
    return faults(rows).sortWithinPartitions("conv_id", "turn", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, a row an edit in order; role and text are null where a row is deleted.

    Rows of a turn are taken by role and text; a null role or text counts as a blank, a null
    turn comes first, rows of a null conv_id are one conversation.  Any initial but s, u and
    a fits nowhere.  No rows give none; other columns are not read.  A conversation of any
    length passes one task as a stream: its order, like the digest of its text, is one chain.
    """
    return _in_order(rows).mapInPandas(_edited, EDITED)


def summaries(rows: DataFrame) -> DataFrame:
    """Faults, cost, edits' initials and digest of the repaired text of every conversation; as ``repaired`` otherwise."""
    return _in_order(rows).mapInPandas(_summaries, SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with damage by crc32 of ``conv_id:turn``, a null in either as a blank; nulls in role and text too."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % DAMAGES
    keyed = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return keyed.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Every conv_id with the gaps in its turns after damage, its faults, and its repair.

    A conversation that damage leaves without rows has zeros, no edits and the digest of an
    empty text.  Ids, gaps and summaries meet by conv_id, null included, one row each.
    """
    after = damaged(rows)
    turns = after.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = turns.select(F.col("conv_id").alias("a"), "gaps")
    repaired_ = summaries(after).withColumnRenamed("conv_id", "b")
    ids = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    met = ids.join(found, F.col("conv_id").eqNullSafe(F.col("a")), "left").join(repaired_, F.col("conv_id").eqNullSafe(F.col("b")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return met.select(
        "conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The same as DuckDB SQL: the cheapest edits to each state, row by row, as whole strings."""
    insertions = ", ".join(
        f"({first}, {count}, {last}, {['user:', 'assistant:'][:count] if first != USER else ['assistant:'][:count]})" for first, count, last in _INSERTIONS
    )
    ways = [(c, p, q) for c, steps in STEPS.items() for p, q in steps.items()]
    edits = [f"('D', NULL, {s}, {s}, {DELETE}, NULL)" for s in range(4)]
    edits += [f"('K', '{c}', {p}, {q}, {KEEP}, NULL)" for c, p, q in ways]
    edits += [f"('R', NULL, {p}, {q}, {REROLE}, '{ROLES[q]}')" for c, p, q in ways if q in ROLES]
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ')"
    return f"""
WITH RECURSIVE k AS (
  SELECT {key} AS ck, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql(f"{key} || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % {DAMAGES} AS kind
  FROM conversations
),
d AS (
  SELECT ck, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM k, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) u(copy)
),
f AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '{VISIBLE}') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '({VISIBLE})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM d
),
a AS (SELECT *, lag(initial) OVER (PARTITION BY ck ORDER BY i) || initial AS pair FROM f),
counts AS (
  SELECT ck, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM a GROUP BY ck
),
ins(first, inserted, last, puts) AS (VALUES {insertions}),
edits(edit, of, p, q, price, becomes) AS (VALUES {", ".join(edits)}),
w AS (
  SELECT ck, CAST(0 AS BIGINT) AS i, {START} AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS puts FROM counts
  UNION ALL
  SELECT w.ck, f.i, e.q, w.cost + ins.inserted * {INSERT} + e.price + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS total,
    w.audit || repeat('I', ins.inserted) || e.edit AS longer,
    list_concat(w.puts, ins.puts, CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.becomes, f.role) || ':' || f.text] END)
  FROM w JOIN ins ON ins.first = w.state JOIN f ON f.ck = w.ck AND f.i = w.i + 1
  JOIN edits e ON e.p = ins.last AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.of IS NULL OR e.of = f.initial)
  QUALIFY row_number() OVER (PARTITION BY w.ck, e.q ORDER BY total, longer) = 1
),
ended AS (
  SELECT c.*, w.cost + ins.inserted * {INSERT} AS cost, w.audit || repeat('I', ins.inserted) AS audit, list_concat(w.puts, ins.puts) AS puts
  FROM counts c JOIN w ON w.ck = c.ck AND w.i = c.n JOIN ins ON ins.first = w.state AND ins.last IN {ENDS}
  QUALIFY row_number() OVER (PARTITION BY c.ck ORDER BY w.cost + ins.inserted * {INSERT}, w.audit || repeat('I', ins.inserted)) = 1
),
ids AS (SELECT DISTINCT conv_id, {key} AS ck FROM conversations)
SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(puts, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN ended USING (ck)
"""


ORACLE = _sql()
