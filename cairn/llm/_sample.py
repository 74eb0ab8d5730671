"""Bounded, repeatable samples of labelled rows for fitting a classifier; nothing else is ever sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def uniform(*columns) -> Column:
    """A number in [0, 1) that is a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def stratified_ids(rows: DataFrame, id_col: str, label_col: str, per_label: int, total: int) -> DataFrame:
    """At most ``total`` (id, label) rows, about ``per_label`` of each label, picked by a hash of the id."""
    counts = rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("__n"))
    picked = rows.select(id_col, label_col).join(counts, label_col).where(uniform(id_col, F.lit(11)) < F.lit(float(per_label)) / F.col("__n"))
    return picked.orderBy(F.xxhash64(id_col, F.lit(12)), label_col).limit(total).select(id_col, label_col)
