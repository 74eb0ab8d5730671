"""Exact order statistics of groups of any size.

A group of at most ``MOST`` values is aggregated as it is. For a larger one every wanted rank is searched by refinement:
the values between the bounds that hold the rank are counted in ``BINS`` bins (combined before the shuffle, so a task
sends no more rows than there are bins), the bin that holds the rank gives the next bounds, its own least and largest
value, until it has at most ``MOST`` values or a single one. Only that bin's values are ever brought together. A round
leaves a ``BINS``-th of the range, so evenly spread values take one or two rounds; infinite values and NaN, which is
the largest, have bins of their own.

Nulls: null values are not counted; a group without values has nulls. A null key is a group. Empty tables give no
groups, and without keys one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import durable, scratch

MOST, BINS = 1 << 16, 1024


def linear(fraction: float) -> tuple[str, float]:
    """Interpolated at fraction * (n - 1); for one half the mean of the middle two."""
    return "linear", fraction


def nearest(percent: int) -> tuple[str, int]:
    """The value of rank ceil(percent * n / 100), at least 1."""
    return "nearest", percent


def upper_median() -> tuple[str, int]:
    """The value at n / 2 of the sorted values: the larger of the middle two."""
    return "upper", 50


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which null keys are equal; ``b``'s keys go."""
    named = b.withColumnsRenamed({k: f"{k}__" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return a.join(named, on, how).drop(*(f"{k}__" for k in keys))


def _ranks(rule: str, at: float, n: Column) -> tuple[Column, Column]:
    """The two 0-based ranks whose values count; the same for the rules that don't interpolate."""
    if rule == "linear":
        place = F.lit(float(at)) * (n - 1)
        return F.floor(place).cast("long"), F.ceil(place).cast("long")
    rank = F.floor(n / 2).cast("long") if rule == "upper" else F.greatest(F.expr(f"({at} * __n + 99) div 100"), F.lit(1)) - 1
    return rank, rank


def _direct(rule: str, at: float) -> Column:
    if rule == "linear":
        return F.percentile("__v", at)
    values = F.array_sort(F.collect_list("__v"))
    n = F.size(values)
    rank = F.floor(n / 2).cast("int") if rule == "upper" else F.greatest(F.ceil(n * F.lit(int(at)) / 100).cast("int"), F.lit(1)) - 1
    return F.get(values, rank)


def at_ranks(values: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, target, value): the value at each 0-based ``rank`` of ``wanted`` (keys, target, rank, n, lo, hi), whose groups
    have ``n`` values from ``lo`` to ``hi``; ``values`` has the keys and the non-null double ``__v``."""
    state = durable(wanted)
    while True:
        open_ = state.where((F.col("n") > MOST) & ~F.col("lo").eqNullSafe(F.col("hi")))
        if open_.isEmpty():
            break
        v, lo, hi = F.col("__v"), F.col("lo"), F.col("hi")
        first, last = F.greatest(lo, F.lit(-1.7976931348623157e308)), F.least(hi, F.lit(1.7976931348623157e308))
        whole = last - first  # of halves where it is too large for a double
        share = F.when(whole < math.inf, F.try_divide(v - first, whole)).otherwise(F.try_divide(v / 2 - first / 2, last / 2 - first / 2))
        bin_ = F.when(v == -math.inf, -1).when(F.isnan(v), BINS + 1).when(v == math.inf, BINS).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))).cast("int")
        met = _same(values, open_, keys, "inner").where((v >= lo) & (v <= hi))
        counted = met.groupBy(*keys, "target", "rank", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*keys, "target", "rank").orderBy("bin")) - F.col("n")
        chosen = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        rest = state.where((F.col("n") <= MOST) | F.col("lo").eqNullSafe(F.col("hi")))
        state = durable(rest.unionByName(chosen.select(*keys, "target", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi")))
    one = F.col("lo").eqNullSafe(F.col("hi"))
    held = _same(values, state.where(~one), keys, "inner").where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
    listed = held.groupBy(*keys, "target").agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list("__v")).alias("values"))
    return state.where(one).select(*keys, "target", F.col("lo").alias("value")).unionByName(listed.select(*keys, "target", F.get("values", F.col("rank")).alias("value")))


def quantiles(df: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, tuple], **more: Column) -> DataFrame:
    """Of each group of ``df`` the ``wanted`` quantiles (see ``linear``, ``nearest``, ``upper_median``) of ``value`` under their
    names, and ``more`` aggregates of its rows."""
    with scratch(df.sparkSession):
        return durable(_quantiles(df, keys, value, wanted, more), keep=True)


def _quantiles(df: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, tuple], more: dict[str, Column]) -> DataFrame:
    rows = durable(df.withColumn("__v", (F.col(value) if isinstance(value, str) else value).cast("double")))
    values = rows.where(F.col("__v").isNotNull()).select(*keys, "__v")
    sizes = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), *(a.alias(k) for k, a in more.items()))
    sizes = durable(sizes)
    large = sizes.where(F.col("__n") > MOST)
    if large.isEmpty():
        found = values.groupBy(*keys).agg(*(_direct(*q).alias(k) for k, q in wanted.items()))
        return _same(sizes, found, keys, "left").select(*keys, *wanted, *more)
    small = _same(values, sizes.where(F.col("__n") <= MOST).select(*keys), keys, "left_semi").groupBy(*keys).agg(*(_direct(*q).alias(k) for k, q in wanted.items()))
    targets = [F.struct(F.lit(f"{k}_{side}").alias("target"), rank.alias("rank")) for k, q in wanted.items() for side, rank in zip("ab", _ranks(*q, F.col("__n")))]
    asked = large.select(*keys, F.col("__n").alias("n"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.inline(F.array(*targets)))
    found = at_ranks(values, keys, asked)
    of = lambda k, side: F.max(F.when(F.col("target") == f"{k}_{side}", F.col("value"))).alias(f"{k}_{side}")
    found = _same(large, found.groupBy(*keys).agg(*(of(k, side) for k in wanted for side in "ab")), keys, "inner")
    big = [F.col(f"{k}_a").alias(k) if rule != "linear" else _between(k, at).alias(k) for k, (rule, at) in wanted.items()]
    found = found.select(*keys, *big)
    if keys:  # without keys the one group is large, and an aggregate of no small groups would be a second row
        found = small.unionByName(found)
    return _same(sizes, found, keys, "left").select(*keys, *wanted, *more)


def _between(name: str, at: float) -> Column:
    place = F.lit(float(at)) * (F.col("__n") - 1)
    share = place - F.floor(place)
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    return F.when(share == 0, a).otherwise(a * (1 - share) + b * share)
