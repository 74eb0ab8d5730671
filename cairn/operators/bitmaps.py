"""Exact distinct counts of whole-number ids by bitmaps of 64-bit words.

An id is a bit of the word that holds 64 consecutive ids. A word is one row of a hash aggregate with a buffer of eight
bytes, so it is combined before the shuffle and inside generated code; ids in sequence make a 64th of the rows that a
distinct count shuffles, and ids far apart one row each, as there. Words of finer groups roll up to coarser ones by OR,
where distinct counts would have to read the rows again. Null ids are no ids; negative ones are ids like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "word"


def word(of: Column) -> Column:
    return F.shiftright(of.cast("long"), 6)


def bit(of: Column) -> Column:
    """The id's bit in its word; null for null."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), of.cast("long").bitwiseAND(63).cast("int"))


def size(bits: Column) -> Column:
    """The number of ids in words, summed; 0 where there are none."""
    return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0))


def conditional_counts(df: DataFrame, of: Column, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many different ids meet each condition."""
    words = df.groupBy(word(of).alias(WORD)).agg(*(F.bit_or(F.when(holds, bit(of))).alias(name) for name, holds in conditions.items()))
    return words.agg(*(size(F.col(name)).alias(name) for name in conditions))


def counts_by_group(df: DataFrame, group: str, ids: dict[str, Column]) -> DataFrame:
    """(total, group, kind, n, shared): the different ids of each kind in every group and, where ``total`` is true, in
    all groups together, with how many are in more than one. Rows of ``df`` are read once."""
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), word(of).alias(WORD), bit(of).alias("bit")) for kind, of in ids.items()))
    words = df.select(group, F.inline(rows)).where(F.col("bit").isNotNull()).groupBy("kind", WORD, group).agg(F.bit_or("bit").alias("bits"))
    held = words.groupBy("kind", WORD).agg(F.collect_list(F.struct(group, "bits")).alias("parts"))  # at most one part a group
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("twice"))

    def fold(so_far: Column, part: Column) -> Column:
        again = so_far["seen"].bitwiseAND(part["bits"])
        return F.struct(so_far["seen"].bitwiseOR(part["bits"]).alias("seen"), so_far["twice"].bitwiseOR(again).alias("twice"))

    held = held.withColumn("all", F.aggregate("parts", zero, fold))
    name = lambda of: of.cast(df.schema[group].dataType).alias(group)
    entry = lambda whole, of, n, twice: F.struct(F.lit(whole).alias("total"), name(of), F.bit_count(n).alias("n"), F.bit_count(twice).alias("shared"))
    own = F.transform("parts", lambda p: entry(False, p[group], p["bits"], F.lit(0).cast("long")))
    whole = F.array(entry(True, F.lit(None), F.col("all.seen"), F.col("all.twice")))
    return held.select("kind", F.inline(F.concat(own, whole))).groupBy("total", group, "kind").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"))
