"""Answer-key, credit and scale arithmetic on label arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the published scale and exam lengths ----
SCALE_MIN, SCALE_MAX, CUT_SCORE = 100, 1000, 720
DEFAULT_LENGTH = 60


def key_labels(option_labels: Column, correct: Column) -> Column:
    """Correct labels in option order; labels that were not offered fall away."""
    return F.filter(option_labels, lambda label: F.array_contains(correct, label))


def chosen_labels(option_labels: Column, selected: Column) -> Column:
    picked = F.coalesce(selected, F.array().cast("array<string>"))
    return F.filter(option_labels, lambda label: F.array_contains(picked, label))


def select_count(declared: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(declared, F.lit(0)), F.size(key)).cast("int")


def combinations(n: Column, k: Column) -> Column:
    """C(n, k) as a bigint product; each partial product divides exactly."""
    steps = F.when(
        (k >= 1) & (k <= n), F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    ).otherwise(F.array().cast("array<int>"))
    product = F.aggregate(
        steps,
        F.lit(1).cast("bigint"),
        lambda acc, i: F.floor(acc * (n - k + i) / i).cast("bigint"),
    )
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(product)


def unrank(labels: Column, k: Column, rank: Column) -> Column:
    """The k-subset of ``labels`` at ``rank`` (from 0) in lexicographic order of positions.

    Each label either takes the ranks of the subsets that hold it or passes on the rest, so
    nothing is enumerated.  Holds while C(n, k) * k fits a bigint (n of 56 at any k).
    """
    div = lambda a, b: F.call_function("div", a, b)
    places = F.transform(labels, lambda x, i: F.struct(x.alias("label"), (F.size(labels) - i).cast("bigint").alias("left")))
    start = F.struct(
        rank.cast("bigint").alias("rank"), k.cast("bigint").alias("k"), combinations(F.size(labels), k).alias("ways"), F.array().cast("array<string>").alias("taken")
    )

    def step(acc: Column, place: Column) -> Column:
        holding = div(acc["ways"] * acc["k"], place["left"])  # subsets of what is left that hold this label
        take = acc["rank"] < holding
        return F.struct(
            F.when(take, acc["rank"]).otherwise(acc["rank"] - holding).alias("rank"),
            F.when(take, acc["k"] - 1).otherwise(acc["k"]).alias("k"),
            F.when(take, holding).otherwise(acc["ways"] - holding).alias("ways"),
            F.when(take, F.concat(acc["taken"], F.array(place["label"]))).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(places, start, step, lambda acc: acc["taken"])


def is_correct(key: Column, chosen: Column) -> Column:
    """Both arrays are in option order and free of repeats, so equality is enough."""
    return (F.size(chosen) > 0) & (chosen == key)


def outcome(key: Column, chosen: Column, wanted: Column) -> Column:
    return (
        F.when(F.size(chosen) == 0, F.lit("blank"))
        .when(chosen == key, F.lit("correct"))
        .when(F.size(chosen) > wanted, F.lit("over_selected"))
        .when(F.size(chosen) < wanted, F.lit("under_selected"))
        .otherwise(F.lit("incorrect"))
    )


def wrong_ways(options: Column, wanted: Column) -> Column:
    """Denominator of the wrong-answer penalty: C(n, s) - 1 (0 = no penalty)."""
    return F.greatest(combinations(options, wanted) - F.lit(1), F.lit(0).cast("bigint"))


def credit(key: Column, chosen: Column, ways: Column) -> Column:
    return (
        F.when(F.size(chosen) == 0, F.lit(0.0))
        .when(chosen == key, F.lit(1.0))
        .when(ways > 0, F.lit(-1.0) / ways)
        .otherwise(F.lit(0.0))
    )


def scaled_score(
    proportion: Column,
    scale_min: Column | int = SCALE_MIN,
    scale_max: Column | int = SCALE_MAX,
) -> Column:
    low = F.lit(scale_min) if isinstance(scale_min, int) else scale_min
    high = F.lit(scale_max) if isinstance(scale_max, int) else scale_max
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), proportion))
    return F.bround(low + clamped * (high - low), 0).cast("int")


def cut_proportion(scale_min: Column, scale_max: Column, cut_score: Column) -> Column:
    """The share of items the cut stands for on the linear scale; 0 on a scale of no width."""
    return F.coalesce(F.try_divide((cut_score - scale_min).cast("double"), scale_max - scale_min), F.lit(0.0))


def remaining_seconds(limit: Column, started: Column, now: Column) -> Column:
    elapsed = (F.unix_micros(now) - F.unix_micros(started)) / F.lit(1e6)
    return F.greatest(F.lit(0).cast("bigint"), F.ceil(limit - elapsed).cast("bigint"))
