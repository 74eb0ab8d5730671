"""Exact quantiles against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import selection as S

WANTED = {"q1": S.linear(0.25), "half": S.linear(0.5), "p95": S.linear(0.95), "least": S.nearest(0), "p5": S.nearest(5), "p50": S.nearest(50), "all": S.nearest(100), "up": S.upper_median()}


def brute(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    n = len(v)
    if not n:
        return dict.fromkeys(WANTED)
    out = {}
    for name, (rule, at) in WANTED.items():
        if rule == "linear":
            place = at * (n - 1)
            lo, share = int(place), place - int(place)
            out[name] = v[lo] if not share else v[lo] * (1 - share) + v[lo + 1] * share
        else:
            out[name] = v[n // 2] if rule == "upper" else v[max(-(-at * n // 100), 1) - 1]
    return out


def agree(a, b):
    return a is None and b is None or a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def check(df, groups, keys):
    got = S.quantiles(df, keys, "v", WANTED, rows=F.count(F.lit(1)), largest=F.max("v")).collect()
    assert len(got) == len(groups)
    for r in got:
        values = groups[tuple(r[k] for k in keys)]
        want = brute([x for x in values if x is not None])
        assert r.rows == len(values) and all(agree(r[k], want[k]) for k in WANTED), (r, want)


@pytest.mark.parametrize("most", [3, 50, 1 << 16])
def test_equals_sorted_lists(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "BINS", 8)
    rng = random.Random(most)
    groups = {
        ("even", 1): [float(k) for k in range(200)], ("even", None): [rng.gauss(0, 1) for _ in range(301)], (None, 1): [rng.choice([1.5, 2.5, -0.0, 0.0]) for _ in range(99)],
        (None, None): [None, None], ("skew", 2): [2.0**k for k in range(-300, 300, 7)], ("one", 3): [7.0] * 80, ("few", 3): [3.0, 1.0], ("nulls", 4): [None, 2.0, None, 9.0, 4.0],
        ("ends", 5): [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0] * 9,
    }
    rows = [(a, b, v) for (a, b), values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b long, v double")
    check(df, groups, ["a", "b"])


@pytest.mark.parametrize("most", [2, 1 << 16])
def test_infinite_values_and_nan(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    for values in ([math.inf] * 3 + [-math.inf] * 3 + [1.0, 2.0], [math.nan] * 5 + [1.0] * 4 + [math.inf], [math.nan] * 4):
        df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
        got = S.quantiles(df, ["k"], "v", {k: q for k, q in WANTED.items() if q[0] != "linear"}).first()
        want = brute([*values])
        assert all(agree(got[k], want[k]) for k, q in WANTED.items() if q[0] != "linear"), (got, want)


def test_a_million_values_in_one_group(spark, monkeypatch):
    seen = []
    plain = S._same
    largest = lambda b: b.agg(F.max("n")).first()[0] if {"rank", "n"} <= set(b.columns) else None
    monkeypatch.setattr(S, "_same", lambda a, b, keys, how: seen.append(largest(b)) or plain(a, b, keys, how))
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), (F.xxhash64("id") / 1e9).alias("v"))
    got = S.quantiles(df, ["k"], "v", {"half": S.linear(0.5), "p95": S.nearest(95)}).first()
    v = np.sort(np.array([r.v for r in df.select("v").collect()]))
    assert got.half == pytest.approx((v[499_999] + v[500_000]) / 2) and got.p95 == v[949_999]
    held = [n for n in seen if n is not None]
    assert held[0] == 1_000_000 and held[-1] <= S.MOST  # what is refined first and what is brought together at last


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert S.quantiles(df, ["k"], "v", WANTED).count() == 0
    r = S.quantiles(df, [], "v", WANTED, rows=F.count(F.lit(1))).first()
    assert r.rows == 0 and r.half is None
    r = S.quantiles(spark.range(101).select(F.col("id").cast("double").alias("v")), [], "v", WANTED).first()
    assert (r.half, r.p5, r.up) == (50.0, 5.0, 50.0)


def test_a_large_table_without_keys_is_one_row(spark, monkeypatch):
    """the one group is larger than what is aggregated as it is."""
    monkeypatch.setattr(S, "MOST", 10)
    df = spark.range(101).selectExpr("double(id) AS v")
    got = S.quantiles(df, [], "v", {"median": S.linear(0.5), "p95": S.linear(0.95)}, n=F.count("v")).collect()
    assert [tuple(r) for r in got] == [(50.0, 95.0, 101)]
