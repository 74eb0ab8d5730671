"""Thresholds and quantiles from per-key histograms, and global positions without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import durable


def _binned(df: DataFrame, key: str, value: str, bin_of) -> DataFrame:
    """(key, bin, n, lo, hi, total, filled): a counted histogram of each key. Counts are combined before the shuffle."""
    limits = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("total"), F.count_if(F.col(value) > 0).alias("filled"))
    limits = durable(limits)  # so that by its own size it is the side that is sent, not the values
    binned = df.join(limits, key).withColumn("bin", bin_of(F.col(value), F.col("lo"), F.col("hi")).cast("int"))
    return binned.groupBy(key, "bin", "lo", "hi", "total", "filled").agg(F.count(F.lit(1)).alias("n"))


def otsu(df: DataFrame, key: str, value: str, bins: int = 256) -> DataFrame:
    """The bin and threshold of the greatest variance between classes, the first bin on a tie. Values are binned over
    bins - 1 steps, while the threshold is the upper border of the bin over ``bins`` steps. Uniform keys have none."""
    h = _binned(df, key, value, lambda v, lo, hi: F.floor((v - lo) / (hi - lo) * (bins - 1))).where("hi > lo")
    w = Window.partitionBy(key).orderBy("bin")
    whole = Window.partitionBy(key)
    weighted = F.col("bin") * F.col("n")
    s = h.withColumns({"bc": F.sum("n").over(w), "bs": F.sum(weighted).over(w), "all": F.sum(weighted).over(whole)})
    rest = F.col("total") - F.col("bc")
    difference = F.col("bs") / F.col("bc") - (F.col("all") - F.col("bs")) / rest
    s = s.where(rest > 0).withColumn("variance", F.col("bc").cast("double") * rest.cast("double") * difference * difference)
    best = s.groupBy(key).agg(F.min_by(F.struct("bin", "lo", "hi"), F.struct(-F.col("variance"), "bin")).alias("b")).select(key, "b.*")
    return best.withColumn("threshold", F.col("lo") + (F.col("bin") + 1.0) * (F.col("hi") - F.col("lo")) / bins)


def histogram_quantiles(df: DataFrame, key: str, value: str, bins: int, fractions: dict[str, float]) -> DataFrame:
    """For each name the first bin at which floor(total * fraction) values are seen."""
    h = _binned(df, key, value, lambda v, lo, hi: F.floor((v - lo) * ((bins - 1) / (hi - lo))))
    seen = h.withColumn("seen", F.sum("n").over(Window.partitionBy(key).orderBy("bin")))
    return seen.groupBy(key).agg(*[F.min(F.when(F.col("seen") >= F.floor(F.col("total") * f), F.col("bin"))).alias(name) for name, f in fractions.items()])


def robust_scale(df: DataFrame, key: str, value: str, bins: int = 1000, cut_share: float = 0.001, top: float = 255.0) -> DataFrame:
    """The bin below which all but a share of the filled values lie, and the factor that scales it to ``top``."""
    h = _binned(df, key, value, lambda v, lo, hi: F.least(F.floor((v - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1)))
    seen = h.withColumn("seen", F.sum("n").over(Window.partitionBy(key).orderBy("bin")))
    enough = F.col("seen") >= F.col("total") - F.floor(cut_share * F.col("filled"))
    cut = seen.groupBy(key).agg((F.min(F.when(enough, F.col("bin"))) - 1).alias("cut"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    edge = F.col("lo") + (F.col("cut") + 1) * (F.col("hi") - F.col("lo")) / bins
    return cut.withColumn("factor", top / (edge - F.col("lo")))


def positions(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """1-based global positions: rows are dealt by range over the cluster, stored, numbered within their ranges and
    moved on by the ranges' offsets, so no single task sees all rows. The offsets are a table of one row a range."""
    part = "range_of_row"
    while part in df.columns:
        part += "_"
    ranged = durable(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(name)).withColumn(name, F.coalesce(F.sum(name).over(before), F.lit(0)))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return own.join(F.broadcast(offsets), part).select(*df.columns, (F.col(name) + F.col("_own")).alias(name))
