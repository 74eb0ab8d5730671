"""The four segmentation paths and their refusals on phantoms, against dense arrays."""

from dataclasses import replace

import numpy as np
import pytest

from cairn.operators import segmentation as SG

from . import head_brute as H

RULES = SG.Rules(
    depth=2, closing_voxels=1, growth=1, least_ml=0.02, core_closing=1.5, core_thickness=1.4, core_depth=3, core_ml=0.004, core_growth=2, core_rim=1, shell=(1, 2.5), smoothing=1.6, smoothed_margin=2,
    least_voxels=3, core_headroom=20,
)


def phantoms():
    """Name -> array [z, y, x]: a bright head with dark cavities."""
    rng = np.random.default_rng(5)
    z, y, x = np.mgrid[-9:10, -10:11, -10:11]
    head = np.sqrt(z**2 + y**2 + x**2) < 8.6
    ball = lambda cx, cz, r: np.sqrt((x - cx) ** 2 + y**2 + (z - cz) ** 2) < r
    base = lambda: np.where(head, 800.0, 0.0) + rng.normal(0, 8, head.shape).clip(-20, 20)
    two = ball(-2.5, 0, 2.3) | ball(2.5, 0, 2.3)
    channels = (np.abs(y) < 1) & ((np.abs(x + 2.5) < 1) | (np.abs(x - 2.5) < 1)) & (z < 0) & head
    frame = np.where(np.sqrt((z - 4) ** 2 + y**2 + x**2) < 9.5, 800.0, 0.0) + rng.normal(0, 5, head.shape)
    frame[(np.abs(x) < 5) & (np.abs(y) < 2) & (z > 2)] = 260
    dark = {
        "two": two, "side": ball(3.5, 0, 2.6), "leak": two | channels, "speckle": two & ((x + y + z) % 3 != 0), "fluid": np.sqrt(z**2 + y**2 + x**2) < 7, "tiny": ball(0, 0, 1.2), "none": two & False,
    }
    return {name: np.where(m, 260.0, base()) for name, m in dark.items()} | {"flat": np.zeros(head.shape), "frame": frame, "noise": rng.gamma(2, 100, head.shape)}


def both(spark, volumes, dark, rules):
    names = list(volumes)
    rows = [(n, int(x), int(y), int(z), float(v)) for n, name in enumerate(names) for (z, y, x), v in np.ndenumerate(volumes[name])]
    df = spark.createDataFrame(rows, "vol long, x int, y int, z int, v double").repartition(4)
    shape = next(iter(volumes.values())).shape[::-1]
    mask, verdicts = SG.segment(df, "vol", "v", shape, (1.0, 1.0, 1.0), dark, rules)
    found = {name: np.zeros(v.shape, bool) for name, v in volumes.items()}
    for r in mask.collect():
        found[names[r.vol]][r.z, r.y, r.x] = True
    said = {names[r.vol]: (r.path, r.refusal) for r in verdicts.collect()}
    assert len(said) == len(names)
    for name, v in volumes.items():
        want = H.segment(v, (1.0, 1.0, 1.0), dark, rules)
        assert said[name] == want[1:], (name, said[name], want[1:])
        assert (found[name] == want[0]).all(), name
    return set(said.values())


def test_dark_fluid_by_all_paths(spark):
    seen = both(spark, phantoms(), True, RULES)
    assert {("depth", None), ("cores", None), (None, "oneSided"), (None, "notFound"), (None, "implausiblySmall"), (None, "noHead"), (None, "truncatedByFrame"), (None, "thresholdDidNotIsolateCsf")} == seen


def test_smoothing_finds_what_channels_hide(spark):
    chosen = {k: v for k, v in phantoms().items() if k in ("leak", "noise")}
    assert both(spark, chosen, True, replace(RULES, core_thickness=1.0)) == {("smoothedCores", None), (None, "thresholdDidNotIsolateCsf")}


def test_bright_fluid_goes_by_depth_only(spark):
    bright = {k: np.where(v > 600, 500.0, np.where(v > 100, 1000.0, 0.0)) for k, v in phantoms().items() if k in ("two", "side", "fluid", "frame")}
    assert both(spark, bright, False, RULES) == {("depth", None), (None, "oneSided"), (None, "thresholdDidNotIsolateCsf"), (None, "truncatedByFrame")}


def test_query_equals_dense_arrays(spark, sf_dir):
    from cairn.plans import _bind, registry, voxels

    got = {r.vol: (r.path, r.refusal, r.voxels) for r in registry.queries()["vox_segment_paths"](spark, sf_dir).collect()}
    rows = _bind.voxels(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")).collect()
    volumes = {}
    for r in rows:
        volumes.setdefault(r.vol, np.zeros((4, 4, 4)))[r.z, r.y, r.x] = r.v
    assert len(got) == len(volumes)
    for vol, v in volumes.items():
        mask, path, refusal = H.segment(v, voxels._MM[::-1], True, voxels.PATH_RULES)
        assert got[vol] == (path, refusal, int(mask.sum()))
    assert len({x[:2] for x in got.values()}) >= 3


def test_no_volumes(spark):
    none = spark.createDataFrame([], "vol long, x int, y int, z int, v double")
    mask, verdicts = SG.segment(none, "vol", "v", (3, 3, 3), (1.0, 1.0, 1.0))
    assert mask.count() == 0 and verdicts.count() == 0


@pytest.mark.parametrize("dark", [True, False])
def test_phantoms_reach_the_refusals(dark):
    """What the phantoms stand for, from the dense arrays alone."""
    seen = {H.segment(v, (1.0, 1.0, 1.0), dark, RULES)[1:] for v in phantoms().values()}
    assert (None, "noHead") in seen
