"""Evans index of whole heads: the width of the frontal horns over the inner width of the skull in the same slice.

Volumes are in long form (see ``volumes``); all volumes of a table go through each step together. Three ways:

* ``measure``: the horns are the widest line across the middle that a given mask has in its frontal part.
* ``seeded``: the horns are two marked points.
* ``on_slices``: without a mask. Dark voxels between the bright ends of their line are opened, so that furrows go and
  ventricles stay; the widest central line of what is left is taken to the ends of the unopened fluid.

The skull is sought by brightness: tissue of the slice is eroded, the region at the middle of the horns is dilated back
into the tissue, and on each line its ends are taken half-way into the dark band between brain and what is bright
outside. All steps after the choice of the slice work on one slice a volume. A volume gives one row, with an index or
the refusal; empty tables give no rows. Values that are null count as dark; ties go to the first slice and line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import histograms as HG
from . import volumes as V
from .rules import first_match
from .store import durable

AXES = V.AXES
#: Neighbours within a slice.
SIDES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))
AROUND = (*SIDES, (1, 1, 0), (1, -1, 0), (-1, 1, 0), (-1, -1, 0))


@dataclass(frozen=True)
class Rules:
    """Shares of the way from front to back, and mm where not said otherwise."""

    frontal: tuple[float, float] = (0.0, 0.35)
    frontal_of_slices: tuple[float, float] = (0.25, 0.50)
    midline_reach: float = 10
    least_side: float = 3
    separation: float = 2
    widest_band: float = 12
    opening: float = 2
    #: The darkest fluid as a share of the threshold of the background.
    fluid_floor: float = 0.25


@dataclass(frozen=True)
class Directions:
    """The axes of a volume that run from side to side, from front to back and from slice to slice."""

    side: str = "x"
    depth: str = "y"
    slices: str = "z"
    front_is_low: bool = True

    @property
    def order(self) -> tuple[str, str, str]:
        return self.side, self.depth, self.slices


def directions(of_axes: Sequence[Sequence[float]], alignment: float = 0.8) -> Directions | None:
    """From the unit vectors of the axes x, y, z in patient space (left, back, up): the axis nearest to each of the three
    directions, or None if one is oblique or an axis would have to serve for two."""
    found = []
    for part in range(3):
        shares = [abs(vector[part]) for vector in of_axes]
        found.append(shares.index(max(shares)))
        if max(shares) < alignment:
            return None
    if len(set(found)) < 3:
        return None
    return Directions(*(AXES[i] for i in found), front_is_low=of_axes[found[1]][1] > 0)


class Heads:
    """The volumes of one table (key, x, y, z, value) of a shape and spacing. Inside, x runs across the head, y from front
    to back or back to front, and z over the slices."""

    def __init__(self, grid: DataFrame, key: str, value: str, shape: V.Shape, mm: V.Triple, rules: Rules = Rules(), turned: Directions | None = Directions()):
        self.key, self.rules, self.turned = key, rules, turned
        self.at = [key, *AXES]
        self.every = grid.select(key).distinct()
        if turned is None:
            return
        places = [AXES.index(a) for a in turned.order]
        self.shape: V.Shape = tuple(shape[i] for i in places)
        self.mm: V.Triple = tuple(mm[i] for i in places)
        g = self.seen(grid, F.col(value).cast("double").alias("v"))
        known = durable(HG.otsu(g.where("v IS NOT NULL"), key, "v").select(key, "threshold"))
        bright = F.coalesce(F.col("v") > F.col("threshold"), F.lit(False))
        self.grid = durable(g.join(known, key).withColumn("bright", bright))

    def seen(self, df: DataFrame, *more: Column) -> DataFrame:
        """``df`` with its axes in the head's order."""
        return df.select(self.key, *(F.col(a).cast("int").alias(b) for a, b in zip(self.turned.order, AXES)), *more)

    def horns(self, mask: DataFrame, window: tuple[float, float]) -> DataFrame:
        """(key, plane, line, first, last): the widest line of the mask's central regions in a window from its front on."""
        key, r = self.key, self.rules
        reach, side = r.midline_reach / self.mm[0], r.least_side / self.mm[0]
        extent = mask.groupBy(key).agg(F.min("y").alias("low"), F.max("y").alias("high"))
        of_line = self.grid.where("bright").groupBy(key, "z", "y").agg(((F.min("x") + F.max("x")) / 2).alias("m"))
        middle = durable(of_line.groupBy(key, "z").agg(F.avg("m").alias("middle")).join(extent, key))
        labels = durable(V.components(mask, key, self.shape, AROUND))
        central = labels.join(middle, [key, "z"]).where(F.abs(F.col("x") - F.col("middle")) <= reach).select(key, "label").distinct()
        lines = V.of_components(labels, central, key).groupBy(key, "z", "y").agg(F.min("x").alias("first"), F.max("x").alias("last"))
        front = F.col("low") if self.turned.front_is_low else F.col("high")
        span = F.col("high") - F.col("low")
        step = F.abs(F.col("y") - front)
        fits = step.between(F.floor(span * window[0]), F.floor(span * window[1])) & (F.col("first") <= F.col("middle") - side) & (F.col("last") >= F.col("middle") + side)
        fit = lines.join(middle, [key, "z"]).withColumn("step", step).where(fits)
        best = F.min_by(F.struct(F.col("z").alias("plane"), F.col("y").alias("line"), "first", "last"), F.struct(F.col("first") - F.col("last"), "z", "step"))
        return durable(fit.groupBy(key).agg(best.alias("b")).select(key, "b.*"))

    def skull(self, horns: DataFrame, mask: DataFrame | None = None) -> DataFrame:
        """(key, skull_line, skull_first, skull_last): the widest inner line of the skull in the slice of the horns. What
        is in ``mask`` counts as tissue, though it is dark."""
        key, r = self.key, self.rules
        at = horns.select(key, F.col("plane").alias("z"), "line", F.floor((F.col("first") + F.col("last")) / 2).alias("centre"))
        slice_ = self.grid.join(at, [key, "z"])
        tissue = slice_.where("bright").select(*self.at)
        if mask is not None:
            tissue = tissue.unionByName(mask.join(at, [key, "z"], "left_semi").select(*self.at)).distinct()
        slice_, tissue = durable(slice_.where("bright").select(*self.at)), durable(tissue)
        steps = max(1, round(r.separation / self.mm[0]))
        core = tissue
        for _ in range(steps):
            core = V.erode(core, key, self.shape, keep_border=False, offsets=SIDES)
        core = durable(core)
        way = F.abs(F.col("x") - F.col("centre")) + F.abs(F.col("y") - F.col("line"))
        seed = core.join(at.drop("z"), key).groupBy(key).agg(F.min_by(F.struct(*AXES), F.struct(way, "y", "x")).alias("s")).select(key, "s.*")
        brain = V.reconstruct(seed, core, key, self.shape, SIDES)
        nx, ny, _ = self.shape
        allowed = tissue.where(F.col("x").between(1, nx - 2) & F.col("y").between(1, ny - 2))
        for _ in range(steps):
            brain = durable(V.dilate(brain, key, self.shape, allowed, SIDES))
        lines = brain.groupBy(key, "y").agg(F.min("x").alias("first"), F.max("x").alias("last"))
        left = F.min(F.when(F.col("x") < F.col("first"), F.col("first") - 1 - F.col("x")))
        right = F.min(F.when(F.col("x") > F.col("last"), F.col("x") - F.col("last") - 1))
        bands = slice_.select(key, "y", "x").join(lines, [key, "y"]).groupBy(key, "y", "first", "last").agg(left.alias("left"), right.alias("right"))
        bands = bands.where(F.greatest("left", "right") < math.ceil(r.widest_band / self.mm[0])).where("left IS NOT NULL AND right IS NOT NULL")
        inner = F.col("last") - F.col("first") + 1 + (F.col("left") + F.col("right")) / 2
        ends = F.struct(F.col("y").alias("skull_line"), (F.col("first") - F.col("left") / 2).alias("skull_first"), (F.col("last") + F.col("right") / 2).alias("skull_last"))
        return durable(bands.groupBy(key).agg(F.min_by(ends, F.struct(-inner, "y")).alias("b")).select(key, "b.*"))

    def lengthened(self, horns: DataFrame, stops: DataFrame, most: int | None = None) -> DataFrame:
        """``horns`` whose ends go on along their line to the next voxel of ``stops``, or by ``most`` voxels."""
        key = self.key
        near = stops.select(key, F.col("z").alias("plane"), F.col("y").alias("line"), "x").join(horns, [key, "plane", "line"])
        before = F.max(F.when(F.col("x") < F.col("first"), F.col("x"))).alias("before")
        after = F.min(F.when(F.col("x") > F.col("last"), F.col("x"))).alias("after")
        found = horns.join(near.groupBy(key).agg(before, after), key, "left")
        first, last = F.coalesce(F.col("before") + 1, F.lit(0)), F.coalesce(F.col("after") - 1, F.lit(self.shape[0] - 1))
        if most is not None:
            first, last = F.greatest(first, F.col("first") - most), F.least(last, F.col("last") + most)
        return found.withColumns({"first": first, "last": last}).drop("before", "after")

    def fluid(self) -> DataFrame:
        """Dark voxels between the first and last bright one of their line, but for the darkest."""
        g = self.grid
        ends = g.where("bright").groupBy(self.key, "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        dark = (F.col("v") < F.col("threshold")) & (F.col("v") > F.col("threshold") * self.rules.fluid_floor)
        return durable(g.where(dark).join(ends, [self.key, "z", "y"]).where("x BETWEEN a AND b").select(*self.at))

    def rows(self, volumes: DataFrame, refusals: list[tuple[str, Column]], horns: DataFrame, skull: DataFrame, width: Column | None = None) -> DataFrame:
        """A row a volume: refusal, evans, plausible, plane, line, first, last, skull_line, skull_first, skull_last. The
        first refusal that holds empties the rest."""
        found = volumes.join(horns, self.key, "left").join(skull, self.key, "left")
        wide = F.col("last") - F.col("first") + 1 if width is None else width / self.mm[0]
        evans = wide / (F.col("skull_last") - F.col("skull_first") + 1)
        chain = [*refusals, ("frontalHornsNotFound", F.col("plane").isNull()), ("innerSkullNotFound", F.col("skull_line").isNull())]
        found = found.withColumn("refusal", first_match(chain)).withColumn("evans", evans).withColumn("plausible", F.col("evans").between(0.10, 0.60))
        kept = ["evans", "plausible", "plane", "line", "first", "last", "skull_line", "skull_first", "skull_last"]
        return found.select(self.key, "refusal", *(F.when(F.col("refusal").isNull(), F.col(k)).alias(k) for k in kept))

    def refused(self, volumes: DataFrame, refusals: list[tuple[str, Column]]) -> DataFrame:
        """The rows of volumes whose axes are oblique."""
        kinds = ["evans double", "plausible boolean", "plane int", "line int", "first int", "last int", "skull_line int", "skull_first double", "skull_last double"]
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (k.split() for k in kinds)]
        return volumes.select(self.key, first_match([*refusals, ("axesNotAligned", F.lit(True))]).alias("refusal"), *empty)


def _weighted(volumes: DataFrame) -> tuple[str, Column]:
    return "weightingNotSupported", ~F.coalesce(volumes["weighting"].isin("T1", "Flair"), F.lit(False))


def measure(heads: Heads, volumes: DataFrame, mask: DataFrame, grow: float = 0) -> DataFrame:
    """``volumes`` (key, weighting, reliable) by the ``mask`` (key, x, y, z) of their ventricles; the ends of the horns may
    go on into dark voxels of their line by ``grow`` mm."""
    refusals = [_weighted(volumes), ("segmentationRefused", ~F.coalesce(volumes["reliable"], F.lit(False)))]
    if heads.turned is None:
        return heads.refused(volumes, refusals)
    ventricles = durable(heads.seen(mask).distinct())
    horns = heads.horns(ventricles, heads.rules.frontal)
    skull = heads.skull(horns, ventricles)
    if grow > 0:  # after the skull, whose dark band is sought from the mask's own ends
        horns = heads.lengthened(horns, heads.grid.where("bright"), max(1, round(grow / heads.mm[0])))
    return heads.rows(volumes, refusals, horns, skull)


def seeded(heads: Heads, points: DataFrame) -> DataFrame:
    """By two marked points of each volume, ``points`` (key, x1, y1, z1, x2, y2, z2), fractions of voxels allowed."""
    if heads.turned is None:
        return heads.refused(points, [])
    key, (nx, ny, nz) = heads.key, heads.shape
    ends = [[F.col(f"{a}{i}").cast("double") for a in heads.turned.order] for i in (1, 2)]
    (x1, y1, z1), (x2, y2, z2) = ends
    same = (F.rint(z1) == F.rint(z2)) & F.rint(z1).between(0, nz - 1)
    apart = F.sqrt(sum((((a - b) * m) * ((a - b) * m) for a, b, m in zip(*ends, heads.mm)), F.lit(0.0)))
    line = F.greatest(F.lit(0), F.least(F.lit(ny - 1), F.rint((y1 + y2) / 2)))
    whole = {"plane": F.rint(z1), "line": line, "first": F.rint(F.least(x1, x2)), "last": F.rint(F.greatest(x1, x2))}
    marked = durable(points.select(key, F.coalesce(same, F.lit(False)).alias("same"), apart.alias("apart"), *(v.cast("int").alias(k) for k, v in whole.items())))
    horns = marked.where("same").select(key, *whole)
    rows = heads.rows(marked.select(key, "same", "apart"), [("markedPointsOnDifferentPlanes", ~F.col("same"))], horns, heads.skull(horns), F.col("apart"))
    return rows


def on_slices(heads: Heads, volumes: DataFrame) -> DataFrame:
    """``volumes`` (key, weighting) without a mask."""
    if heads.turned is None:
        return heads.refused(volumes, [_weighted(volumes)])
    raw = heads.fluid()
    opened = durable(V.opened(raw, heads.key, heads.shape, heads.rules.opening, heads.mm[:2], at_least=True))
    horns = heads.horns(opened, heads.rules.frontal_of_slices)
    skull = heads.skull(horns)
    rest = heads.grid.select(*heads.at).join(V.merged(raw), heads.at, "left_anti")
    there = heads.grid.where("bright").select(heads.key).distinct().withColumn("headed", F.lit(True))
    refusals = [_weighted(volumes), ("segmentationRefused", F.col("headed").isNull())]
    return heads.rows(volumes.join(there, heads.key, "left"), refusals, heads.lengthened(horns, rest), skull)
