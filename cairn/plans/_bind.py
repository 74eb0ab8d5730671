"""Logical roles bound to the driver's tables: the series, studies and volumes that queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ["Unusable", "Baseline", "Extended"]


def series(t) -> DataFrame:
    """Line items as imaging series."""
    c = F.col
    return t("lineitem").select(
        c("l_orderkey").alias("study"), c("l_linenumber").alias("ord"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"),
        (c("l_quantity") / 10).alias("thickness"), (c("l_quantity") / 10 * (1 + c("l_discount"))).alias("spacing"),
        (c("l_tax") * 10 + 0.1).alias("row_mm"), (c("l_discount") * 10 + 0.1).alias("col_mm"),
        (c("l_linenumber") * 20).cast("int").alias("slices"), (c("l_partkey") % 3 * 128).cast("int").alias("rows"), F.lit(256).alias("cols"),
        (c("l_linestatus") == "F").alias("volume"), (c("l_returnflag") == "R").alias("contrast"), c("l_returnflag").alias("source"),
        F.element_at(F.array(*map(F.lit, ["T1", "Flair", "T2", "Unknown"])), (c("l_suppkey") % 4 + 1).cast("int")).alias("weighting"),
        (c("l_discount") - 0.05).alias("nx"), (c("l_tax") - 0.04).alias("ny"), ((c("l_quantity") - 25) / 500).alias("nz"), c("l_extendedprice").alias("price"),
    )


#: The same as DuckDB SQL; ``series`` is its name there.
SERIES = (
    "series AS (SELECT l_orderkey AS study, l_linenumber AS ord, l_partkey AS part, l_suppkey AS supp, l_quantity / 10 AS thickness, l_quantity / 10 * (1 + l_discount) AS spacing, "
    "l_tax * 10 + 0.1 AS row_mm, l_discount * 10 + 0.1 AS col_mm, (l_linenumber * 20)::INT AS slices, (l_partkey % 3 * 128)::INT AS \"rows\", 256 AS cols, "
    "l_linestatus = 'F' AS volume, l_returnflag = 'R' AS contrast, l_returnflag AS source, ['T1', 'Flair', 'T2', 'Unknown'][l_suppkey % 4 + 1] AS weighting, "
    "l_discount - 0.05 AS nx, l_tax - 0.04 AS ny, (l_quantity - 25) / 500 AS nz, l_extendedprice AS price FROM lineitem)"
)


def studies(t) -> DataFrame:
    """Orders as dated measurements of customers."""
    orders = t("orders").select(F.col("o_orderkey").alias("study"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("recorded"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))
    groups = t("customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("nation"))
    return orders.join(groups, "subject")


STUDIES = "studies AS (SELECT o_orderkey AS study, o_custkey AS subject, o_orderdate AS recorded, o_totalprice AS value, o_orderstatus AS status, c_mktsegment AS grp, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"


def automatic(t) -> DataFrame:
    """A second measurement of each study: the sum of its line items."""
    return t("lineitem").groupBy(F.col("l_orderkey").alias("study")).agg(F.sum("l_extendedprice").alias("auto"))


AUTOMATIC = "automatic AS (SELECT l_orderkey AS study, sum(l_extendedprice) AS auto FROM lineitem GROUP BY l_orderkey)"


def voxels(t) -> DataFrame:
    """Embeddings as volumes of 4 x 4 x 4 voxels, one row each: (vol, x, y, z, v)."""
    long = t("embeddings").select(F.col("vec_id").alias("vol"), F.posexplode("embedding").alias("i", "v"))
    return long.select("vol", (F.col("i") % 4).alias("x"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("y"), F.floor(F.col("i") / 16).cast("int").alias("z"), F.col("v").cast("double").alias("v"))


VOXELS = (
    "voxels AS (SELECT vec_id AS vol, (i % 4)::INT AS x, (i // 4 % 4)::INT AS y, (i // 16)::INT AS z, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"
)
