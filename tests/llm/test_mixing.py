import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing

from .brute import targets

rng = random.Random(2)


def docs(spark, n=600):
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(int(rng.paretovariate(1) * 20))), rng.choice(["é", "b", "a", "z"] + ["hot"] * 6)) for i in range(n)]
    rows += [(1000, "x y z", None), (1001, None, "a"), (None, "q", "b"), (None, "q", "b"), (1002, "tiny", "single")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_copies(spark):
    df = docs(spark)
    got = mixing.mix(df, bucket_rows=16).toPandas()
    assert len(got) == df.count()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    ordered = {k: int(sizes[k]) for k in sorted((s for s in sizes.index if isinstance(s, str)), key=lambda s: s.encode())} | {None: int(sizes[sizes.index.isna()].iloc[0])}
    want = targets(ordered)
    assert np.isclose(sum(want.values()), sum(ordered.values()))
    for source, part in got.groupby(got["source"].fillna("__null")):
        key = None if source == "__null" else source
        assert np.allclose(part["target"], want[key])
        assert abs(part["taken"].sum() - want[key]) <= part["size"].max()
    assert (got["taken"] == got["size"] * got["copies"]).all() and (got["copies"] <= 3).all()
    again = mixing.mix(df.repartition(7), bucket_rows=16).toPandas()
    keys = ["doc_id", "size", "taken"]
    assert got[keys].sort_values(keys).values.tolist().__repr__() == again[keys].sort_values(keys).values.tolist().__repr__()


def test_capped_sources(spark):
    df = spark.createDataFrame([(i, "w " * (1000 if i == 0 else 1), f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas().set_index("source")
    want = targets({f"s{i}": 1000 if i == 0 else 1 for i in range(6)})
    assert np.allclose(got["target"], pd.Series(want)[got.index]) and got.loc["s1", "taken"] == 3


@pytest.mark.parametrize("settle", [mixing._settle_equal, mixing._settle_pairs])
def test_rounding_keeps_mass_and_expectation(settle):
    gen = np.random.default_rng(0)
    size = (gen.pareto(1, 20) * 50 + 1).astype(int)
    p = np.full(20, 0.3) if settle is mixing._settle_equal else gen.uniform(0.01, 0.99, 20)
    base = pd.DataFrame({"doc_id": range(20), "size": size, "slot": 0, "bucket": 0, "n": 1, "each": 0, "once": 0, "p": p})
    mean = np.zeros(20)
    for _ in range(1500):
        out = settle(base.assign(turn=gen.random(20), draw=gen.random(20))).sort_values("doc_id")
        assert ((out["p"] > 0) & (out["p"] < 1)).sum() <= 1 and np.isclose((out["p"] * out["size"]).sum(), (p * size).sum(), rtol=1e-6)
        mean += out["p"].to_numpy()
    assert np.abs(mean / 1500 - p).max() < 0.06


def test_empty_and_blank(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], schema)).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]


def test_rows_keep_their_columns(spark):
    df = docs(spark).withColumnRenamed("doc_id", "id").withColumns({"size": F.lit("own"), "copies": F.lit(None).cast("int"), "doc_id": F.monotonically_increasing_id()})
    repeated = df.where("id < 200").withColumn("id", F.lit(None).cast("long"))
    df = df.unionByName(repeated).unionByName(repeated)
    got = mixing.with_copies(df, id_col="id", bucket_rows=16)
    assert got.columns == [*df.columns, "size_", "source_size", "target", "copies_", "taken"]
    rows = got.toPandas()
    assert len(rows) == df.count() and (rows["taken"] == rows["size_"] * rows["copies_"]).all() and rows["copies_"].between(0, 3).all()
    plain = mixing.mix(df, id_col="id", bucket_rows=16).toPandas()
    key = lambda x, size, copies: sorted(map(repr, zip(x["id" if "id" in x and size == "size_" else "doc_id"].fillna(-1), x["source"].fillna(""), x[size], x[copies])))
    assert key(rows, "size_", "copies_") == key(plain, "size", "copies")


def test_many_equal_rows_are_one_class(spark):
    one = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "s").otherwise("t").alias("source"))
    got = mixing.mix(one, bucket_rows=16).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    assert {r.source: r.n for r in got} == {"s": 3000, "t": 6000}
    assert all(abs(r.taken - r.target) <= 3 and r.most - r.least <= 1 for r in got)
