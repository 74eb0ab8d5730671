"""Voxel operators against dense arrays, and those against definitions, on random volumes that are no cubes."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import matrices as M
from cairn.operators import volumes as V
from cairn.operators.store import durable

from . import voxel_brute as K

rng = np.random.default_rng(3)
MASKS = rng.random((6, 4, 5, 3)) < 0.6


def near(a):
    return [tuple(np.add(a, d)) for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]


def test_label_is_reachability():
    for m, got in zip(MASKS, K.label(MASKS)):
        seen = {}
        for p in itertools.product(*map(range, m.shape)):
            if m[p] and p not in seen:
                todo, root = [p], int(np.ravel_multi_index(p, m.shape)) + 1
                while todo:
                    q = todo.pop()
                    if q in seen or not all(0 <= x < n for x, n in zip(q, m.shape)) or not m[q]:
                        continue
                    seen[q] = root
                    todo += near(q)
        assert all(got[p] == seen.get(p, 0) for p in itertools.product(*map(range, m.shape)))


def test_distance_is_nearest_outside():
    step = np.array((1.5, 1.1, 0.9))
    for m, got in zip(MASKS, K.distance(MASKS, tuple(step))):
        off = np.argwhere(~m)
        for p in itertools.product(*map(range, m.shape)):
            assert np.isclose(got[p], np.sqrt((((off - p) * step) ** 2).sum(axis=1)).min())
    assert np.isinf(K.distance(np.ones((1, 2, 2, 2), bool), (1, 1, 1))).all()


def test_borders_differ():
    full = np.ones((1, 3, 3, 3), bool)
    assert K.erode(full, True).sum() == 27 and K.erode(full, False).sum() == 1


def test_holes_are_filled():
    shell = np.ones((1, 5, 5, 5), bool)
    shell[0, 2, 2, 2] = False
    assert K.fill_outside(shell).all()
    shell[0, 2, 2, 3:] = False
    assert not K.fill_outside(shell)[0, 2, 2, 2]


def test_phantom_is_segmented():
    z, y, x = np.mgrid[-12:13, -12:13, -12:13]
    r = np.sqrt(z**2 + y**2 + x**2)
    v = np.where(r < 4, 100.0, np.where(r < 11, 800.0, 0.0))[None]
    mask, codes = K.segment(v, (1, 1, 1))
    assert codes == [None] and abs(int(mask.sum()) - int((r < 4).sum())) <= 5
    mask, codes = K.segment(np.zeros((1, 4, 4, 4)), (1, 1, 1))
    assert not mask.any() and codes[0] is not None


def test_resample_keeps_linear_fields():
    v = np.broadcast_to(np.arange(4.0)[:, None, None] * 1.5, (4, 2, 2))[None]
    got = K.resample(v, (1.5, 0.75, 0.75), 0.75)
    assert np.allclose(got[0, :, 0, 0], np.arange(7) * 0.75)


# ---- the long form against dense arrays

#: Voxels along x, y and z; arrays are [volume, z, y, x].
SHAPE, MM = (3, 5, 4), (0.9, 1.1, 1.5)
VALUES = np.round(rng.normal(0, 1, (5, *SHAPE[::-1])), 3)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(int(n), int(x), int(y), int(z), float(VALUES[n, z, y, x])) for n, z, y, x in np.ndindex(VALUES.shape)]
    return spark.createDataFrame(rows, "vol long, x int, y int, z int, v double").repartition(5)


def dense(df, value=None, fill=0, shape=None):
    out = np.full(shape or VALUES.shape, fill, bool if value is None else float)
    for r in df.collect():
        out[r.vol, r.z, r.y, r.x] = True if value is None else r[value]
    return out


def mm(triple):
    return triple[::-1]


def test_morphology(grid):
    mask, m = grid.where("v > -0.3"), VALUES > -0.3
    assert (dense(V.dilate(mask, "vol", SHAPE)) == K.dilate(m)).all()
    assert (dense(V.dilate(grid.where("v > 1"), "vol", SHAPE, grid.where("v > 0"))) == K.dilate(VALUES > 1, VALUES > 0)).all()
    for border in (True, False):
        assert (dense(V.erode(mask, "vol", SHAPE, border)) == K.erode(m, border)).all()
    for radius in (0.9, 1.0, 1.5, 2.0):
        assert (dense(V.opened(mask, "vol", SHAPE, radius)) == K.opened(m, radius)).all()
    got = V.grow_limited(grid.where("v < -1"), grid.where("v <= 0"), "vol", SHAPE, (2, 2, 1))
    assert (dense(got) == K.grow_limited(VALUES < -1, VALUES, 0.0, (1, 2, 2))).all()


def test_connectivity(grid):
    mask, m = grid.where("v > 0"), VALUES > 0
    labels = V.components(mask, "vol", SHAPE)
    assert (dense(labels, "label") == K.label(m)).all()
    assert (dense(V.of_components(labels, V.largest(labels, "vol"), "vol")) == K.largest(m)).all()
    assert (dense(V.reconstruct(grid.where("v > 1"), mask, "vol", SHAPE)) == K.reconstruct(VALUES > 1, m)).all()
    assert (dense(V.fill_outside(grid, mask, "vol", SHAPE)) == K.fill_outside(m)).all()
    assert V.components(grid.where("false"), "vol", SHAPE).count() == 0


@pytest.mark.parametrize("links", [1 << 18, 0])
def test_components_of_many_slabs(spark, monkeypatch, links):
    """Slabs of one or two slices; their links settled in one group a volume or over the cluster."""
    shape = (6, 5, 9)
    masks = rng.random((4, *shape[::-1])) < 0.45
    rows = [tuple(map(int, (n, x, y, z))) for n, z, y, x in np.argwhere(masks)]
    df = spark.createDataFrame(rows, "vol long, x int, y int, z int").repartition(5)
    monkeypatch.setattr(V, "LINKS", links)
    for voxels in (1, 60):
        monkeypatch.setattr(V, "SLAB", voxels)
        assert (dense(V.components(df, "vol", shape), "label", shape=masks.shape) == K.label(masks)).all()


def test_components_in_slices(spark, monkeypatch):
    shape = (7, 6, 3)
    masks = rng.random((3, *shape[::-1])) < 0.5
    df = spark.createDataFrame([tuple(map(int, (n, x, y, z))) for n, z, y, x in np.argwhere(masks)], "vol long, x int, y int, z int")
    diagonal = [((2, 1), (3, 1)), ((2, 1), (3, -1)), ((2, -1), (3, 1)), ((2, -1), (3, -1))]
    for offsets, corners in ((V.PLANE4, ()), (V.PLANE8, diagonal)):
        want = np.where(masks, np.arange(1, masks[0].size + 1).reshape(masks.shape[1:]), masks[0].size + 1)
        for _ in range(masks[0].size):
            low = want
            for steps in (*(((a, b),) for a in (2, 3) for b in (1, -1)), *corners):
                moved = want
                for axis, by in steps:
                    moved = K.shifted(moved, axis, by, masks[0].size + 1)
                low = np.minimum(low, moved)
            want = np.where(masks, low, masks[0].size + 1)
        got = dense(V.components(df, "vol", shape, offsets), "label", shape=masks.shape)
        assert (got == np.where(masks, want, 0)).all()


def test_one_large_volume(spark):
    """64 x 64 x 200 voxels in several slabs and tasks: the labels of a plain flood over runs."""
    shape = (64, 64, 200)
    mask = rng.random(shape[::-1]) < 0.31
    z, y, x = np.nonzero(mask)
    df = spark.createDataFrame(pd.DataFrame({"vol": np.ones(len(x), np.int64), "x": x.astype(np.int32), "y": y.astype(np.int32), "z": z.astype(np.int32)}))
    got = dense(V.components(df.withColumn("vol", F.lit(0)), "vol", shape), "label", shape=(1, *mask.shape))[0]
    assert (got > 0).sum() == mask.sum()
    for axis in range(3):
        a, b = np.take(got, range(got.shape[axis] - 1), axis), np.take(got, range(1, got.shape[axis]), axis)
        assert (a == b)[(a > 0) & (b > 0)].all()
    place = np.arange(mask.size).reshape(mask.shape) + 1
    label, first = np.unique(got[mask].astype(np.int64), return_index=True)
    assert (label == place[mask][first]).all()  # named by its first voxel
    assert (K.label(mask[None])[0] == got).all()


def test_chamfer_lengths_take_two_passes():
    for _ in range(40):
        off = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.2
        got, at = V._chamfer(off), np.argwhere(off)
        for p in np.ndindex(off.shape):
            d = np.abs(at - p)
            want = (d.max(axis=1) + (2**0.5 - 1) * d.min(axis=1)).min() if len(at) else np.inf
            assert np.isclose(got[p], want)


def test_envelope_is_the_least_parabola():
    for n in (1, 2, 9, 64):
        for _ in range(60):
            own = [float(x) for x in rng.choice([0.0, 1.0, 7.5, 100.0, np.inf], n)]
            got = V._envelope(own, 1.3)
            assert np.allclose(got, [min(own[j] + (1.3 * (i - j)) ** 2 for j in range(n)) for i in range(n)])


def test_envelope_takes_linear_time():
    times = {}
    for n in (2_000, 64_000):
        own = [float(x) for x in rng.choice([0.0, 50.0, np.inf], n, p=[0.01, 0.5, 0.49])]
        began = time.process_time()
        V._envelope(own, 1.0)
        times[n] = time.process_time() - began
    assert times[64_000] < 200 * max(times[2_000], 1e-4)  # 32 times the length; a thousand times if it were quadratic


def test_conform_cuts_large_volumes(spark, monkeypatch):
    """More than 5,000 voxels: the brightest thousandth lies above the cut; ranks found by refinement as well."""
    shape = (20, 18, 16)
    values = np.round(rng.gamma(2, 100, (2, *shape[::-1])), 2)
    values[rng.random(values.shape) < 0.3] = 0
    rows = [(int(n), int(x), int(y), int(z), float(values[n, z, y, x])) for n, z, y, x in np.ndindex(values.shape)]
    df = spark.createDataFrame(rows, "vol long, x int, y int, z int, v double")
    want = K.conform(values, (1.0, 1.0, 1.0), 16)
    assert (want == 255).sum() >= 4
    for most in (1 << 16, 100):
        monkeypatch.setattr(V.SEL, "MOST", most)
        assert np.allclose(dense(V.conform(df, "vol", "v", shape, (1.0, 1.0, 1.0), 16), "v", shape=want.shape), want)


def test_along_lines(grid):
    got = dense(V.distance(grid.withColumn("m", F.col("v") > -1), "vol", "m", MM), "mm")
    assert np.allclose(got, K.distance(VALUES > -1, mm(MM)))
    assert np.isinf(dense(V.distance(grid.withColumn("m", F.lit(True)), "vol", "m", MM), "mm")).all()
    assert np.allclose(dense(V.gaussian(grid, "vol", "v", (0.2, 0.6, 1.0)), "v"), K.gaussian(VALUES, (1.0, 0.6, 0.2)))
    want = K.resample(VALUES, mm(MM), 0.7)
    assert np.allclose(dense(V.resample(grid, "vol", "v", SHAPE, MM, 0.7), "v", shape=want.shape), want)
    cube = K.conform(VALUES, mm(MM), 7)
    got = V.conform(grid, "vol", "v", SHAPE, MM, 7)
    assert np.allclose(dense(got, "v", shape=cube.shape), cube)
    back = V.project_back(got.withColumn("l", (F.col("v") > 128).cast("int")), "vol", "l", 7, SHAPE, MM)
    assert (dense(back, "l") == K.project_back((cube > 128).astype(int), mm(MM), SHAPE[::-1])).all()


def test_segment(spark, grid):
    mask, codes = K.segment(VALUES, mm(MM))
    got, verdicts, _ = V.segment(grid, "vol", "v", SHAPE, MM)
    assert (dense(got) == mask).all()
    assert [r.refusal for r in verdicts.orderBy("vol").collect()] == codes
    z, y, x = np.mgrid[-8:9, -8:9, -8:9]
    r = np.sqrt(z**2 + y**2 + x**2)
    head = np.stack([np.where(r < 3, 100.0, np.where(r < 7.5, 800.0, 0.0)), np.zeros(r.shape)])
    rows = [(int(n), int(i), int(j), int(k), float(head[n, k, j, i])) for n, k, j, i in np.ndindex(head.shape)]
    phantom = spark.createDataFrame(rows, "vol long, x int, y int, z int, v double")
    got, verdicts, _ = V.segment(phantom, "vol", "v", (17, 17, 17), (1, 1, 1))
    mask, codes = K.segment(head, (1, 1, 1))
    assert (dense(got, shape=head.shape) == mask).all() and mask[0].sum() >= (r < 3).sum()
    assert [r.refusal for r in verdicts.orderBy("vol").collect()] == codes == [None, "noHead"]


def test_matrices(spark):
    m = np.array([[0.9, 0.1, 0.0, 4], [-0.2, 1.1, 0.3, 5], [0.05, 0, 1.5, 6], [0, 0, 0, 1]])
    df = spark.createDataFrame([(m.ravel().tolist(),), ([0.0] * 15 + [1.0],), (None,)], "m array<double>")
    got = [r[0] for r in df.select(M.inverse(F.col("m"))).collect()]
    assert np.allclose(np.reshape(got[0], (4, 4)), np.linalg.inv(m)) and got[1] is None and got[2] is None
    one = df.limit(1).select(M.product(F.col("m"), M.inverse(F.col("m"))), F.array(*M.applied(F.col("m"), (1, 2, 3)))).first()
    assert np.allclose(np.reshape(one[0], (4, 4)), np.eye(4)) and np.allclose(one[1], (m @ [1, 2, 3, 1])[:3])


def test_voxels_are_not_sent_through_the_driver(spark):
    """stored masks are small files, but joins by coordinates merge them."""
    grid = durable(spark.range(64).selectExpr("id div 16 AS vol", "int(id % 4) AS x", "int(id div 4 % 4) AS y", "0 AS z", "double(id) AS v"))
    mask = durable(grid.where("x > 0"))
    near = V.dilate(mask, "vol", (4, 4, 1), grid)
    filled = V.fill_outside(grid, mask, "vol", (4, 4, 1))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (near, filled)]
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert near.count() == 64 and filled.count() == 48
