"""The Evans index by mask, by marked points and on slices, on phantoms against dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import evans as E

from . import evans_brute as K

MM = (1.5, 1.2, 4.0)
RULES = E.Rules(midline_reach=4, least_side=2, separation=1.5, widest_band=8, opening=2.0)
COLUMNS = ["refusal", "evans", "plane", "line", "first", "last", "skull_line", "skull_first", "skull_last"]


def phantoms():
    """Name -> (volume [z, y, x], ventricles): skin, dark bone, bright brain, ventricles of two horns and a body."""
    rng = np.random.default_rng(11)
    z, y, x = np.mgrid[0:4, 0:30, 0:26]
    out = {}
    for n in range(9):
        cx, cy = 12.5 + rng.uniform(-1, 1), 14.5 + rng.uniform(-1, 1)
        d = np.hypot((x - cx) / 11.5, (y - cy) / 13.5) + 0.02 * abs(z - 1.5)
        v = np.where(d < 1, 700.0, 20.0)
        v[(d > 0.75) & (d < 0.88)] = 60
        spread = 2 + n * 0.45
        horns = (abs(abs(x - cx) - (cy - y) * 0.5) < 1.7) & (y < cy) & (y > cy - spread * 1.5)
        body = (abs(x - cx) < 2.5) & (y >= cy) & (y < cy + 4)
        mask = (horns | body) & (z > 0) & (d < 0.7)
        v[mask] = 220
        v[(abs(y - cy - 8) < 0.7) & (d < 0.7)] = 220  # a furrow
        v += rng.normal(0, 12, v.shape)
        if n == 3:
            mask = mask & (x > cx)  # one side only
        if n == 4:
            v[d > 0.72] = 10  # no skin, so the band does not end
        if n == 5:
            mask = mask & False
        if n == 6:
            v[rng.random(v.shape) < 0.15] = 150
        if n == 7:
            v, mask = rng.gamma(2, 100, v.shape), rng.random(v.shape) < 0.35
        out[n] = (np.round(v, 3), mask)
    out[9] = (np.full(z.shape, 5.0), z >= 0)
    return out


def long(spark, volumes, turn=(2, 1, 0)):
    """Rows whose x, y, z are the axes ``turn`` of the arrays."""
    rows, masks = [], []
    for n, (v, m) in volumes.items():
        for at, value in np.ndenumerate(v):
            place = [int(at[i]) for i in turn]
            rows.append((n, *place, float(value)))
            if m[at]:
                masks.append((n, *place))
    return spark.createDataFrame(rows, "vol long, x int, y int, z int, v double").repartition(5), spark.createDataFrame(masks, "vol long, x int, y int, z int")


def rows_of(df):
    return {r.vol: tuple(r[k] for k in COLUMNS) for r in df.collect()}


def agree(got, want):
    assert set(got) == set(want)
    for n, expected in want.items():
        assert got[n][0] == expected[0], (n, got[n], expected)
        if expected[0] is None:
            assert got[n][1:] == pytest.approx(expected[1:], rel=1e-12), n
        else:
            assert got[n][1:] == (None,) * 8


@pytest.fixture(scope="module")
def heads(spark):
    volumes = phantoms()
    grid, mask = long(spark, volumes)
    return volumes, E.Heads(grid, "vol", "v", (26, 30, 4), MM, RULES), mask


def listed(spark, names, weighting="T1"):
    return spark.createDataFrame([(n, weighting, True) for n in names], "vol long, weighting string, reliable boolean")


@pytest.mark.parametrize("grow", [0, 4.0])
def test_by_mask(spark, heads, grow):
    volumes, h, mask = heads
    want = {n: K.measure(v, m, MM, RULES, grow=grow) for n, (v, m) in volumes.items()}
    agree(rows_of(E.measure(h, listed(spark, volumes), mask, grow)), want)
    assert {w[0] for w in want.values()} == {None, "frontalHornsNotFound", "innerSkullNotFound"} and sum(w[0] is None for w in want.values()) >= 4


def test_on_slices(spark, heads):
    volumes, h, _ = heads
    want = {n: K.on_slices(v, MM, RULES) for n, (v, _) in volumes.items()}
    agree(rows_of(E.on_slices(h, listed(spark, volumes))), want)
    assert {None, "frontalHornsNotFound", "segmentationRefused"} <= {w[0] for w in want.values()} and sum(w[0] is None for w in want.values()) >= 3


def test_by_points(spark, heads):
    volumes, h, _ = heads
    rng = np.random.default_rng(3)
    points = {n: ((8 + rng.uniform(0, 2), 11.4, 1.2), (16 + rng.uniform(0, 2), 9.9, 1.2 if n != 2 else 2.6)) for n in volumes}
    points[8] = ((17.2, 40.0, 2.0), (7.5, 30.0, 2.0))
    df = spark.createDataFrame([(n, *map(float, a), *map(float, b)) for n, (a, b) in points.items()], "vol long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    want = {n: K.seeded(v, *points[n], MM, RULES) for n, (v, _) in volumes.items()}
    agree(rows_of(E.seeded(h, df)), want)
    assert {w[0] for w in want.values()} == {None, "markedPointsOnDifferentPlanes", "innerSkullNotFound"}


def test_other_axes_and_a_front_that_is_high(spark):
    """Slices along x, lines along z from back to front, across along y."""
    volumes = {n: p for n, p in phantoms().items() if n in (1, 6, 8)}
    turned = E.directions([(0, 0, 1), (0.99, 0.1, 0), (0.1, -0.99, 0)])
    assert turned == E.Directions("y", "z", "x", front_is_low=False)
    flipped = {n: (v[:, ::-1], m[:, ::-1]) for n, (v, m) in volumes.items()}
    grid, mask = long(spark, flipped, turn=(0, 2, 1))
    h = E.Heads(grid, "vol", "v", (4, 26, 30), (MM[2], MM[0], MM[1]), RULES, turned)
    agree(rows_of(E.measure(h, listed(spark, flipped), mask)), {n: K.measure(v, m, MM, RULES, front_low=False) for n, (v, m) in flipped.items()})
    agree(rows_of(E.on_slices(h, listed(spark, flipped))), {n: K.on_slices(v, MM, RULES, front_low=False) for n, (v, m) in flipped.items()})


def test_refusals_before_the_volume_is_read(spark, heads):
    volumes, h, mask = heads
    rows = spark.createDataFrame([(1, "T2", True), (2, None, True), (6, "T1", False), (8, "Flair", None)], "vol long, weighting string, reliable boolean")
    found = rows_of(E.measure(h, rows, mask))
    assert {n: r[0] for n, r in found.items()} == {1: "weightingNotSupported", 2: "weightingNotSupported", 6: "segmentationRefused", 8: "segmentationRefused"}
    assert all(r[1:] == (None,) * 8 for r in found.values())
    assert E.directions([(1, 0, 0), (0, 0.7, 0.7), (0, -0.7, 0.7)]) is None
    assert E.directions([(0.9, 0.9, 0), (0, 0.1, 0), (0, 0, 1)]) is None
    oblique = E.Heads(h.every.select("vol", *(F.lit(0).alias(a) for a in "xyzv")), "vol", "v", (26, 30, 4), MM, RULES, None)
    assert {r[0] for r in rows_of(E.on_slices(oblique, listed(spark, [1, 2]))).values()} == {"axesNotAligned"}


def test_no_volumes(spark):
    grid = spark.createDataFrame([], "vol long, x int, y int, z int, v double")
    h = E.Heads(grid, "vol", "v", (3, 3, 3), MM, RULES)
    none = listed(spark, [1]).limit(0)
    assert E.measure(h, none, grid.drop("v")).count() == 0 and E.on_slices(h, none).count() == 0


def test_nulls_are_dark(spark):
    v, m = phantoms()[1]
    grid, mask = long(spark, {1: (v, m)})
    holed = grid.withColumn("v", F.when((F.col("x") + F.col("y")) % 7 != 0, F.col("v")))
    h = E.Heads(holed, "vol", "v", (26, 30, 4), MM, RULES)
    y, x = np.mgrid[0:30, 0:26]
    gone = np.broadcast_to((x + y) % 7 == 0, v.shape)
    t = K.otsu(v[~gone])
    dark = np.where(gone, v[~gone].min(), v)
    horns = K.find_horns(dark, t, m, MM, RULES.frontal, True, RULES)
    agree(rows_of(E.measure(h, listed(spark, [1]), mask)), {1: K.answer(None, horns, horns and K.find_skull(dark, t, horns, MM, RULES, m))})
