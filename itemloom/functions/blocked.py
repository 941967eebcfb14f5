"""Window functions over groups of any size.

A plain ``Window.partitionBy(group)`` puts a whole group into one task.  Here the group
is cut into blocks by a column that never decreases along the order (a day, a hash
prefix, a line-number range).  Work inside a block is an ordinary window on
``(group, block)``; what must cross blocks is folded into one small carry row per block,
scanned once, and joined back on the same key the window already partitioned by.
Results are exactly those of the plain window.  Keys and block must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


def hash_block(order_key: Column, hex_digits: int = 3) -> Column:
    """Block for an md5 order key: its leading digits, so blocks are evenly filled."""
    return F.left(order_key, F.lit(hex_digits))


def row_number(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` by blocks."""
    keys = list(keys)
    cut = df.withColumn(_BLOCK, block)
    sizes = cut.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__blk_n"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, _BLOCK, F.coalesce(F.sum("__blk_n").over(before), F.lit(0)).alias("__blk_base"))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    ranked = cut.withColumn("__blk_rn", F.row_number().over(inside).cast("bigint"))
    return (
        ranked.join(carry, [*keys, _BLOCK], "left")
        .withColumn(out, F.col("__blk_rn") + F.col("__blk_base"))
        .drop("__blk_rn", "__blk_base", _BLOCK)
    )


def lag(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` by blocks."""
    keys = list(keys)
    cut = df.withColumn(_BLOCK, block).withColumn("__v", value)
    last = cut.groupBy(*keys, _BLOCK).agg(
        F.max_by(F.struct("__v"), F.struct(*order)).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    carry = last.select(*keys, _BLOCK, F.lag("__last").over(across).alias("__carried"))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    stepped = cut.withColumn("__in", F.lag(F.struct("__v")).over(inside))
    return (
        stepped.join(carry, [*keys, _BLOCK], "left")
        .withColumn(out, F.coalesce(F.col("__in"), F.col("__carried"))["__v"])
        .drop("__v", "__in", "__carried", _BLOCK)
    )
