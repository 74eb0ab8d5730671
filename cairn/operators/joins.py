"""Lookups of the domain as joins: fallback keys, decisions, coverage by ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fallback_join(left: DataFrame, right: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """``right`` by the key ``first``; where that finds nothing, by ``second``, unless it is null, blank or the same.

    The found row is taken as a whole, never column by column. Adds one struct column ``found``.
    """
    values = F.struct(*[c for c in right.columns])
    a = right.select(F.col(key).alias("__a"), values.alias("__first"))
    b = right.select(F.col(key).alias("__b"), values.alias("__second"))
    usable = F.when((F.col(second).cast("string") != "") & (F.col(second) != F.col(first)), F.col(second))
    joined = left.join(a, left[first] == F.col("__a"), "left").join(b, usable == F.col("__b"), "left")
    return joined.withColumn("found", F.coalesce("__first", "__second")).drop("__a", "__b", "__first", "__second")


def without_any(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` that no pair (left column, right column) matches: one anti join for each pair, all hashable."""
    return reduce(lambda df, p: df.join(right.select(F.col(p[1]).alias("__k")).distinct(), df[p[0]] == F.col("__k"), "left_anti"), pairs, left)


def ancestors(path: Column, sep: str = "/") -> Column:
    """All folders above a path, the outermost first."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def covered_by(files: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """Files below a listed folder: an equality join on the file's ancestors instead of a prefix comparison."""
    wide = files.withColumn("__a", F.explode(ancestors(F.col(path))))
    return wide.join(folders.select(F.col(folder).alias("__a")).distinct(), "__a", "left_semi").drop("__a").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not replaced, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
