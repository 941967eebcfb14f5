"""The manifest against a plain tree over odd rows, deep trees with small blocks, and single requests."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from itemloom.llm import merkle
from itemloom.llm.shared import scratch

COLUMNS = "doc_id bigint, text string, source string, lang string, n_chars bigint, tree string, rank int, digest string, leaf int, place int, spread int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    fields = (row[0], row[2], row[3], row[4], row[1])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def left_out(levels, i):
    """(is left, digest or None) level by level from the leaf."""
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append((j < i, nodes[j] if j < len(nodes) else None))
        i //= 2
    return out


def plain(rows):
    """The audit's rows, each node made one at a time."""
    langs = sorted({r[3] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[3] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: up([leaf(r) for r in g]) for x, g in groups.items()}
    top = up([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, row in enumerate(groups[x]):
            siblings = left_out(trees[x], i) + left_out(top, k)
            changed = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                changed = (*row[:4], row[4] + 1)
            at = leaf(changed)
            for is_left, d in siblings:
                at = h(d or "", at) if is_left else h(at, d or "")
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[x][-1][0], root, h(*[d for _, d in siblings if d]), at, at == root))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", 2, 3, 4) for r in rows], COLUMNS).repartition(5)


ODD = [(None, "a", "s", "en", 1), (None, None, None, None, None), (5, "", "", "", 0), (5, "é中", "s", "", None), (7, "x" * 200_000, "s", None, 3)] + [(9, "same", "s", "de", 4)] * 5
MANY = [(i * 3 % 1201, f"text {i}", "s", "en" if i % 9 else "fr", i if i % 11 else None) for i in range(2600)]


@pytest.mark.parametrize(("bits", "rows"), [(10, ODD), (10, ODD[:1]), (10, ODD[5:]), (10, MANY), (2, MANY[:67] + ODD)], ids=["odd", "one", "equal", "many", "deep"])
def test_audit_is_that_of_a_plain_tree(spark, monkeypatch, bits, rows):
    monkeypatch.setattr(merkle, "BITS", bits)
    got = merkle.tampered_audit(frame(spark, rows), scratch(spark, "test-merkle")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert merkle.tampered_audit(none, scratch(spark, "test-merkle")).count() == 0


def test_single_requests_and_foreign_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)
    rows = MANY[:150]
    folder = scratch(spark, "test-merkle")
    merkle.build(merkle.leaves(frame(spark, rows)), folder)
    wanted = spark.createDataFrame([("=en", 0), ("=en", 77), ("=fr", 3), ("=fr", 3), ("=de", 0), ("=en", 4000)], "tree string, rank bigint")
    some = merkle.proofs(spark, folder, wanted)
    all_ = merkle.proofs(spark, folder)
    assert sorted((r["tree"], r["rank"]) for r in some.collect()) == [("=en", 0), ("=en", 77), ("=fr", 3)]
    assert some.exceptAll(all_).count() == 0
    ends = some.select((merkle.folded(F.col("leaf"), F.col("siblings")) == F.col("root")).alias("own"), (merkle.folded(F.lit("0" * 64), F.col("siblings")) == F.col("root")).alias("other"))
    assert {tuple(r) for r in ends.collect()} == {(True, False)}
