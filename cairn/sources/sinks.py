"""Sinks: canonical JSON, immutable and content-addressed writes, delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import publish


def canonical_json(value: Column) -> Column:
    """Fields in the struct's order, nulls written out."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def content_key(stamp: Column, content: Column) -> Column:
    """``stamp-`` and 16 digits of the content's hash: equal content has an equal name."""
    return F.concat(stamp, F.lit("-"), F.substring(F.sha2(content, 256), 1, 16))


def write_immutable(df: DataFrame, path: str) -> None:
    """A new folder, or an error: nothing is overwritten."""
    df.write.mode("errorifexists").json(path)


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Text lines (value) in a new folder, or an error; with ``by``, in a folder of that name for each of its values."""
    writer = lines.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).text(path)
    return lines.sparkSession.read.text(path)


def write_idempotent(new: DataFrame, stored: DataFrame | None, key: str, content: str) -> DataFrame:
    """The rows of ``new`` to be appended: equal content under a stored key is left out, other content is an error."""
    if stored is None:
        return new
    old = stored.select(F.col(key).alias("__k"), F.col(content).alias("__c"))
    joined = new.join(old, new[key] == F.col("__k"), "left")
    # One expression: two filters in a row may be tested in either order.
    new_row = F.when(F.col("__k").isNull(), True).when(F.col("__c") == F.col(content), False).otherwise(F.raise_error(F.lit("another content is stored under this key")).cast("boolean"))
    return joined.where(new_row).drop("__k", "__c")


def append_idempotent(new: DataFrame, root: str, key: str, content: str) -> None:
    """Publishes the rows of ``new`` that the table below ``root`` lacks, all or none; see ``write_idempotent``. Two writers of
    the same key can't both store it: the second begins again from what the first has published."""
    spark = new.sparkSession

    def make(head: publish.Manifest):
        stored = publish.read(spark, root, head.version) if head.version else None
        return write_idempotent(new, stored, key, content), False, lambda staged: {}

    publish.update(spark, root, make)


def write_delimited(df: DataFrame, path: str, sep: str = ";", header: bool = True) -> None:
    df.write.option("sep", sep).option("quote", '"').option("escape", '"').option("header", header).csv(path)
