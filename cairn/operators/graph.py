"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import durable, scratch


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) of any one orderable type. Returns (node, component), component the smallest node reachable,
    for every node that has a link to another one, as a stored table. Links with a null end are ignored.

    Each step is a grouped minimum (combined before the shuffle) and a join on the node. Minima are stored before they
    are joined, so that adaptive execution can split the join where one node has very many links; links shrink towards
    one star per component. Each step is written to the shared folder, so plans stay short and a lost executor costs
    one step.
    """
    with scratch(links.sparkSession):
        return _settled(links)


def _settled(links: DataFrame) -> DataFrame:
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    seen = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = durable(both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct())
        down = durable(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        moved = F.array(F.struct(F.col("m").alias("lo"), F.col("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        small = large.join(down, large.hi == down.u).select(F.inline(moved)).where("lo <> hi").distinct()
        edges = durable(small)
        # The steps move minima only downwards: an unchanged number and sum of hashes is an unchanged table.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            return durable(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")), keep=True)
        seen = now
