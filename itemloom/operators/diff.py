"""Change data between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNATTRIBUTED = ("ingest_run_id",)


def row_digest(df: DataFrame, keys: Sequence[str], ignore: Sequence[str] = UNATTRIBUTED) -> Column:
    """Digest of every compared column, so the stored side shuffles key + 64 bytes only."""
    cols = sorted(c for c in df.columns if c not in keys and c not in ignore)
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def plan_table(
    desired: DataFrame, existing: DataFrame, keys: Sequence[str], ignore: Sequence[str] = UNATTRIBUTED
) -> DataFrame:
    """Desired rows (NULL for deletes) with ``change``: insert | update | delete | unchanged."""
    keys = list(keys)
    columns = [c for c in desired.columns if c not in keys]
    want = desired.withColumn("__want", row_digest(desired, keys, ignore))
    have = existing.select(*keys, row_digest(existing.select(*desired.columns), keys, ignore).alias("__have"))
    return want.join(have, keys, "full_outer").select(
        *keys,
        *columns,
        F.when(F.col("__have").isNull(), "insert")
        .when(F.col("__want").isNull(), "delete")
        .when(F.col("__want") != F.col("__have"), "update")
        .otherwise("unchanged")
        .alias("change"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a plan over them must be refused."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def refused_keys(desired: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that forbid a plan, as rows: the side they repeat on and how often they occur there."""

    def side(name: str, df: DataFrame) -> DataFrame:
        return duplicate_keys(df, keys).withColumn("side", F.lit(name))

    return side("desired", desired).unionByName(side("existing", existing))


# Ranges of keys by hash: the number bounds every table of digests, and so what is broadcast.
RANGES = 65536


def _range(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(RANGES)).cast("int")


def range_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(range, rows, total, mix): what the rows of a range add up to, whatever their order.

    Rows are digested and summed before anything moves, so a range costs a row a task.
    """
    text = F.to_json(F.struct(*keys, *[c for c in columns if c not in keys]), {"ignoreNullFields": "false"})
    part = lambda at: F.conv(F.substring("__digest", at, 15), 16, 10).cast("bigint")
    return (
        df.select(_range(keys).alias("__range"), F.sha2(text, 256).alias("__digest"))
        .groupBy("__range")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(part(1).cast("decimal(38,0)")).alias("total"), F.bit_xor(part(16)).alias("mix"))
    )


def differing_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Ranges whose digests differ, at most ``RANGES`` rows."""
    a, b = (range_digests(df, keys, columns).select("__range", F.struct("rows", "total", "mix").alias(name)) for df, name in ((left, "a"), (right, "b")))
    return a.join(b, "__range", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("__range")


def under(df: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is in one of the ranges; they stay where they are."""
    return df.withColumn("__of", _range(keys)).join(F.broadcast(ranges), F.col("__of") == F.col("__range"), "left_semi").drop("__of")


def changed_rows(
    desired: DataFrame, existing: DataFrame, keys: Sequence[str], ignore: Sequence[str] = UNATTRIBUTED
) -> DataFrame:
    """``plan_table`` without its unchanged rows: only ranges that differ are shuffled and compared."""
    compared = [c for c in desired.columns if c not in ignore]
    ranges = differing_ranges(desired, existing, keys, compared)
    plan = plan_table(under(desired, ranges, keys), under(existing, ranges, keys), keys, ignore)
    return plan.where(F.col("change") != "unchanged")


def apply_plan(plan: DataFrame, run_id: Column | str) -> DataFrame:
    """The next version: everything not deleted, re-attributed to the run."""
    stamp = F.lit(run_id) if isinstance(run_id, str) else run_id
    return plan.where(F.col("change") != "delete").drop("change").withColumn("ingest_run_id", stamp)


def change_summary(plans: dict[str, DataFrame]) -> DataFrame:
    """Per table: inserted, updated, deleted, unchanged."""

    def one(name: str, plan: DataFrame) -> DataFrame:
        return plan.select("change").groupBy(F.lit(name).alias("table_name")).agg(
            F.count_if(F.col("change") == "insert").alias("inserted"),
            F.count_if(F.col("change") == "update").alias("updated"),
            F.count_if(F.col("change") == "delete").alias("deleted"),
            F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        )

    return reduce(DataFrame.unionByName, [one(n, p) for n, p in plans.items()])


def affected_questions(question_plan: DataFrame, option_plan: DataFrame) -> DataFrame:
    """Questions whose searchable text may have moved."""
    moved = F.col("change") != "unchanged"
    from_options = option_plan.where(moved).select(F.regexp_replace("id", "#[^#]*$", "").alias("question_id"))
    return (
        question_plan.where(moved)
        .select(F.col("id").alias("question_id"))
        .unionByName(from_options)
        .distinct()
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def verify_fields(source: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key that is missing or unexpected, and per field that differs.

    Digests of key ranges are compared first; rows move under those that differ.
    """
    ranges = differing_ranges(source, stored, [key], fields)
    source, stored = under(source, ranges, [key]), under(stored, ranges, [key])
    s = source.select(key, F.lit(True).alias("__s"), *[F.col(f).alias(f"__s_{f}") for f in fields])
    t = stored.select(key, F.lit(True).alias("__t"), *[F.col(f).alias(f"__t_{f}") for f in fields])
    both = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    tests = F.array_compact(
        F.array(
            F.when(F.col("__t").isNull(), "missing"),
            F.when(F.col("__s").isNull(), "unexpected"),
            *[F.when(both & ~F.col(f"__s_{f}").eqNullSafe(F.col(f"__t_{f}")), f) for f in fields],
        )
    )
    return s.join(t, key, "full_outer").select(key, F.explode(tests).alias("problem"))


def verify_summary(
    source: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Fields checked plus counts of each kind of problem, one row."""
    s = source.select(key, F.lit(True).alias("__s"), *[F.col(f).alias(f"__s_{f}") for f in fields])
    t = stored.select(key, F.lit(True).alias("__t"), *[F.col(f).alias(f"__t_{f}") for f in fields])
    both = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    differ = reduce(
        lambda a, b: a + b,
        [(~F.col(f"__s_{f}").eqNullSafe(F.col(f"__t_{f}"))).cast("bigint") for f in fields],
    )
    return s.join(t, key, "full_outer").agg(
        (F.count_if(both) * len(fields)).alias("fields_checked"),
        F.coalesce(F.sum(F.when(both, differ)), F.lit(0).cast("bigint")).alias("mismatches"),
        F.count_if(F.col("__t").isNull()).alias("missing"),
        F.count_if(F.col("__s").isNull()).alias("unexpected"),
    )


def projection_state(stored_fingerprint: Column, corpus_fingerprint: Column) -> Column:
    return (
        F.when(corpus_fingerprint.isNull(), "no-corpus")
        .when(stored_fingerprint.isNull(), "not-ingested")
        .when(stored_fingerprint != corpus_fingerprint, "stale")
        .otherwise("ready")
    )


def current_run(projection: DataFrame, runs: DataFrame) -> DataFrame:
    """The run any projected row names."""
    return runs.join(
        projection.select(F.col("ingest_run_id").alias("id")).limit(1), "id", "left_semi"
    )
