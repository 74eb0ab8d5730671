"""Micro-fixtures for the semantics that tables without nulls and odd values don't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.functions import dates, geometry, hashing, text
from cairn.functions.uid import remapped
from cairn.operators import joins, journal, latest, rules
from cairn.streaming import retention


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_weighting_words(spark):
    rows = [("T2 FLAIR ax",), ("Т1 mprage",), ("ФЛАИР",), ("ax t2",), ("BRAVO",), ("scout",), (None,), ("",)]
    got = values(spark, "s string", rows, text.first_marker(F.col("s"), text.WEIGHTING_MARKERS, "Unknown"))
    assert [g[0] for g in got] == ["Flair", "T1", "Flair", "T2", "T1", "Unknown", "Unknown", "Unknown"]


def test_weighting_physics(spark):
    schema = "seq string, var string, acq string, tr double, te double, ti double, flip double"
    rows = [("EP", "", "2D", 500.0, 10.0, 0.0, 90.0), ("SE", "", "2D", 0.0, 10.0, 0.0, 90.0), ("IR", "", "2D", 9000.0, 100.0, 2500.0, 90.0), ("GR", "MP", "3D", 1900.0, 3.0, 900.0, 9.0),
            ("GR", "", "2D", 600.0, 10.0, 0.0, 20.0), ("GR", "", "2D", 600.0, 10.0, 0.0, 90.0), ("SE", "", "2D", 600.0, 10.0, 0.0, 20.0), ("SE", "", "2D", 4000.0, 100.0, 0.0, 90.0)]
    got = values(spark, schema, rows, text.weighting_from_physics(*map(F.col, ("seq", "var", "acq", "tr", "te", "ti", "flip"))))
    assert [g[0] for g in got] == ["Unknown", "Unknown", "Flair", "T1", "Unknown", "T1", "T1", "T2"]


def test_negative_words_win(spark):
    got = values(spark, "s string", [("T1 non-contrast",), ("T1 contrast",), ("без контраста",), (None,)], text.contrast_enhanced(F.col("s"), ["non-contrast", "без контраста"], ["contrast", "контраст"]))
    assert [g[0] for g in got] == [False, True, False, False]


def test_leaks(spark):
    rows = [("seen Ivanov here", "IVANOV", False), ("no 1234 here", "123", False), ("no 123 here", "123", False), ("male", "M", True), (" m ", "M", True), ("id 123456789x", "12345678", False)]
    got = values(spark, "v string, s string, n boolean", rows, text.leaks(F.col("v"), F.col("s"), F.col("n")))
    assert [g[0] for g in got] == [True, False, True, False, True, True]


def test_message_shape(spark):
    assert values(spark, "s string", [("slice 12 of 40 in (0018,0015)",)], text.message_shape(F.col("s"))) == [("slice # of # in (0018,0015)",)]


def test_ages(spark):
    rows = [("034Y", None), ("018M", None), ("200Y", None), ("095", None), (None, dt.date(2000, 2, 29)), ("xx", None)]
    at = F.lit("2023-02-28").cast("date")
    assert [g[0] for g in values(spark, "a string, b date", rows, dates.age_years(F.col("a"), F.col("b"), at))] == [34, 1, None, 90, 23, None]
    day_before = F.lit("2023-02-27").cast("date")
    assert values(spark, "a string, b date", rows[4:5], dates.age_years(F.col("a"), F.col("b"), day_before)) == [(22,)]


def test_shifted_dates(spark):
    got = values(spark, "s string", [("20240301",), ("20240301123000.5",), ("2024-03-01",), ("20240231",), (None,)], dates.shifted(F.col("s"), F.lit(-1)))
    assert [g[0] for g in got] == ["20240229", "20240229123000.5", None, None, None]


def test_split_bucket_is_the_hash(spark):
    from hashlib import sha256

    want = int.from_bytes(sha256(b"7:src1").digest()[:8], "big") / 2**64
    assert values(spark, "s string", [("src1",)], hashing.split_bucket(7, F.col("s"))) == [(want,)]


def test_framing_prevents_confusion(spark):
    a, b = values(spark, "a string, b string", [("ab", "c"), ("a", "bc")], hashing.pseudonym("s", F.col("a"), F.col("b")))
    assert a != b


def test_directions(spark):
    rows = [(1.0, 1.0, 0.0), (0.0, -1.0, 1.0), (0.0, 0.0, -2.0), (0.0, 0.0, 0.0)]
    got = values(spark, "x double, y double, z double", rows, geometry.direction((F.col("x"), F.col("y"), F.col("z"))), geometry.plane((F.col("x"), F.col("y"), F.col("z"))))
    assert got == [("Left", "Sagittal"), ("Anterior", "Coronal"), ("Inferior", "Axial"), ("Unknown", "Unknown")]


def test_uid(spark):
    (a,), (b,) = values(spark, "s string", [("x",), (None,)], remapped(F.col("s")))
    assert a.startswith("2.25.") and b is None and (int(a[5:]) >> 76) & 15 == 4


def test_fallback_takes_whole_rows(spark):
    left = spark.createDataFrame([("a", "b"), ("x", "b"), ("x", "x"), ("x", None), ("y", "")], "p string, s string")
    right = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    got = {(r.p, r.s): r.found and r.found.v for r in joins.fallback_join(left, right, "p", "s", "k").collect()}
    assert got == {("a", "b"): None, ("x", "b"): 2, ("x", "x"): None, ("x", None): None, ("y", ""): None}


def test_latest_ties(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, 9), (1, 4, 1), (2, None, 3)], "k long, at long, id long")
    assert sorted(map(tuple, latest.latest(df, ["k"], "at", "id").collect())) == [(1, 5, 9), (2, None, 3)]


def test_journal_states(spark):
    df = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)] + [(2, 0, "q")], "k long, n long, p string")
    kept = journal.chained(df, "k", "n", "p")
    intact = journal.verified(kept, "k", "n", "p").collect()
    assert {r.state for r in intact} == {"Verified"} and all(r.first_broken is None for r in intact)
    edited = kept.withColumn("p", F.when((F.col("k") == 1) & (F.col("n") == 2), "x").otherwise(F.col("p")))
    got = {(r.k, r.n): (r.state, r.first_broken) for r in journal.verified(edited, "k", "n", "p").collect()}
    assert [got[1, i][0] for i in range(5)] == ["Verified", "Verified", "Broken", "Unverifiable", "Unverifiable"] and got[1, 0][1] == 2 and got[2, 0] == ("Verified", None)
    removed = journal.verified(kept.where("n <> 1"), "k", "n", "p").where("k = 1").orderBy("n").collect()
    assert [r.state for r in removed] == ["Verified", "Broken", "Unverifiable", "Unverifiable"]


def test_guards(spark):
    with pytest.raises(ValueError):
        rules.check_ratios(0.5, 0.2, 0.2)
    with pytest.raises(ValueError):
        rules.require_empty(spark.range(1), "not empty")
    with pytest.raises(Exception, match="too large"):
        rules.require(spark.range(3), F.col("id") < 2, "too large").collect()


def test_retention_boundary(spark):
    now = dt.datetime(2024, 1, 2)
    rows = [(False, True, dt.datetime(2024, 1, 1), False), (False, True, dt.datetime(2024, 1, 1, 0, 0, 1), False), (False, False, now, False), (False, True, None, False), (True, False, None, False), (False, True, dt.datetime(2023, 1, 1), True)]
    got = values(spark, "a boolean, k boolean, c timestamp_ntz, l boolean", rows, retention.outcome(F.col("a"), F.col("k"), F.col("c"), F.lit(now).cast("timestamp_ntz"), 24, F.col("l")))
    assert [g[0] for g in got] == ["expired", "kept", "orphaned", "orphaned", "kept", "failed"]


def test_scratch_tables_go(spark):
    import os

    from cairn.operators.graph import connected_components
    from cairn.operators.store import durable, scratch

    where = lambda df: df.inputFiles()[0].removeprefix("file:")
    with scratch(spark):
        gone = durable(spark.range(3))
        with scratch(spark):
            inner, outer = durable(spark.range(4)), durable(spark.range(5), keep=True)
            files = [where(x) for x in (inner, outer)]
        assert not os.path.exists(files[0]) and os.path.exists(files[1]) and outer.count() == 5
        kept, left = durable(spark.range(6), keep=True), where(gone)
    assert not os.path.exists(files[1]) and not os.path.exists(left) and kept.count() == 6
    links = spark.createDataFrame([(1, 2), (3, 2), (7, 9), (5, 5), (None, 1)], "a long, b long")
    assert sorted(map(tuple, connected_components(links).collect())) == [(2, 1), (3, 1), (9, 7)]
    texts = spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")
    assert sorted(map(tuple, connected_components(texts).collect())) == [("b", "a"), ("c", "a")]
    assert connected_components(links.where("false")).count() == 0
