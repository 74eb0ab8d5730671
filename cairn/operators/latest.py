"""Order-dependent choices per key: latest, first, best, ranked, numbered. Every order ends in a full tie-breaker,
since Spark's sorts are not stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in ``order``. Spark keeps one row a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of the greatest ``at``; of equal ones that of the smallest ``tie``. A hash aggregate, combined before
    the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col(tie))).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, "__b.*")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def gaps(df: DataFrame, keys: list[str], position: str, name: str = "gap") -> DataFrame:
    """The distance of each position from the one before it; null for the first."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn(name, F.col(position) - F.lag(position).over(w))


def duplicates(df: DataFrame, key: str, order: list[Column]) -> Column:
    """Whether a row's non-blank key occurred before it."""
    return (F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1) & (F.col(key).cast("string") != "")
