"""Distinct counts by words of 64 ids, against sets."""

import random

from pyspark.sql import functions as F

from cairn.operators import bitmaps as BM


def made(spark, rows):
    return spark.createDataFrame(rows, "g string, a long, b int").repartition(3)


def rows(n=4000):
    r = random.Random(4)
    ids = [r.choice([r.randrange(300), r.randrange(-200, 0), r.randrange(2**62), -r.randrange(2**62), None, 2**63 - 1, -(2**63)]) for _ in range(n)]
    return [(r.choice(["x", "x", "x", "y", "z", None]), i, r.choice([None, 0, 63, 64, -1, r.randrange(1000)])) for i in ids]


def test_counts_by_group_and_shared(spark):
    data = rows()
    got = {(r.total, r.g, r.kind): (r.n, r.shared) for r in BM.counts_by_group(made(spark, data), "g", {"a": F.col("a"), "b": F.col("b")}).collect()}
    want = {}
    for k, kind in ((1, "a"), (2, "b")):
        sets = {}
        for row in data:
            if row[k] is not None:
                sets.setdefault(row[0], set()).add(row[k])
        for g, s in sets.items():
            want[False, g, kind] = (len(s), 0)
        every = set().union(*sets.values())
        want[True, None, kind] = (len(every), sum(1 for i in every if sum(i in s for s in sets.values()) > 1))
    assert got == want


def test_conditions(spark):
    data = rows()
    got = BM.conditional_counts(made(spark, data), F.col("a"), {"x": F.col("g") == "x", "none": F.lit(False), "odd": F.col("b") % 2 == 1}).collect()
    assert [tuple(r) for r in got] == [(len({a for g, a, b in data if g == "x" and a is not None}), 0, len({a for g, a, b in data if b is not None and b % 2 == 1 and b > 0 and a is not None}))]


def test_nothing(spark):
    none = made(spark, rows(5)).where("false")
    assert BM.counts_by_group(none, "g", {"a": F.col("a")}).count() == 0
    assert [tuple(r) for r in BM.conditional_counts(none, F.col("a"), {"n": F.lit(True)}).collect()] == [(0,)]


def test_ids_in_sequence_make_few_words_and_rows_are_read_once(spark, sf_dir, capsys):
    from cairn.plans import registry

    df = spark.range(100_000).select(F.lit("x").alias("g"), "id")
    assert df.groupBy(BM.word(F.col("id"))).count().count() == 100_000 // 64 + 1
    for name in ("pip_inventory", "agg_feasibility"):
        registry.queries()[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert plan.count("FileScan") == 1 and "Expand" not in plan
