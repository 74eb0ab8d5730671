"""Fluid inside heads of unmasked volumes in long form (see ``volumes``), by four paths and the refusals between them.

1. ``depth``: components of fluid voxels all of which are deep in the closed head, grown into partial voxels; refused as
   ``thresholdDidNotIsolateCsf``, ``truncatedByFrame``, ``notFound``, ``implausiblySmall``.
2. ``oneSided``: what depth found is refused if nearly all of it lies on one side of the head's middle.
3. ``cores``: for dark fluid, thick and deep cores in a head closed by distance, of the brightness and height of a
   ventricle and on both sides; they grow into the fluid near them and into their rim up to the half maximum.
4. ``smoothedCores``: the same on the volume smoothed to a given width, kept only away from the frame.

The first path without a refusal counts; else the refusal is that of depth, or of the cores if depth found nothing. All
volumes of a table go through each step together, and only those without a result to the next path.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import histograms as HG
from . import volumes as V
from .rules import first_match
from .store import durable

AXES = V.AXES


@dataclass(frozen=True)
class Rules:
    """Fixed values, in mm, ml and shares where not said otherwise."""

    most_fluid: float = 0.35
    depth: float = 12
    closing_voxels: int = 2
    growth: float = 3
    least_ml: float = 5
    core_closing: float = 10
    core_thickness: float = 3
    core_depth: float = 25
    core_brightness: float = 0.25
    core_headroom: float = 80
    least_side: float = 0.2
    core_ml: float = 0.5
    core_growth: float = 6
    core_rim: float = 2
    shell: tuple[float, float] = (3, 6)
    smoothing: float = 1.5
    smoothed_margin: float = 10
    least_voxels: int = 50
    most_components: int = 2


class Heads:
    """The paths over the volumes of one table (key, x, y, z, value) of a shape and spacing. ``side`` is the axis from
    left to right, ``up`` the axis and direction to the top of the head."""

    def __init__(self, key: str, shape: V.Shape, mm: V.Triple, rules: Rules, side: str = "x", up: tuple[str, int] = ("z", 1)):
        self.key, self.shape, self.mm, self.rules, self.side, self.up = key, shape, mm, rules, side, up
        self.at = [key, *AXES]
        self.ml = math.prod(mm) / 1000

    def flag(self, g: DataFrame, name: str, mask: DataFrame) -> DataFrame:
        """``g`` with a column that says which voxels are in ``mask``."""
        marked = mask.select(*self.at, F.lit(True).alias(name)).distinct()
        return g.join(V.merged(marked), self.at, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def away(self, g: DataFrame, name: str, inside: Column) -> DataFrame:
        """``g`` with each voxel's distance to the nearest one where ``inside`` is false."""
        held = g.withColumn("__in", inside)
        return g.join(V.merged(V.distance(held, self.key, "__in", self.mm).withColumnRenamed("mm", name)), self.at)

    def largest(self, mask: DataFrame) -> DataFrame:
        labels = durable(V.components(mask, self.key, self.shape))
        return V.of_components(labels, V.largest(labels, self.key), self.key)

    def filled(self, g: DataFrame, mask: DataFrame) -> DataFrame:
        return V.fill_outside(g, mask, self.key, self.shape)

    def within(self, g: DataFrame, mask: Column, name: str) -> DataFrame:
        return durable(HG.otsu(g.where(mask), self.key, "v").select(self.key, F.col("threshold").alias(name)))

    def finished(self, labels: DataFrame, heads: DataFrame) -> DataFrame:
        """(key, refusal, selected) of the volumes of ``heads`` (key, head_voxels), by what was selected in them."""
        found = labels.groupBy(self.key).agg(F.count(F.lit(1)).alias("selected"), F.max(V.on_border(self.shape)).alias("framed"))
        r = self.rules
        refusal = first_match([
            ("thresholdDidNotIsolateCsf", F.col("selected") > F.col("head_voxels") * r.most_fluid), ("truncatedByFrame", F.col("framed")),
            ("notFound", F.col("selected") == 0), ("implausiblySmall", F.col("selected") * self.ml < r.least_ml),
        ])
        there = heads.join(found, self.key, "left").withColumns({"selected": F.coalesce("selected", F.lit(0)), "framed": F.coalesce("framed", F.lit(False))})
        return there.select(self.key, refusal.alias("refusal"), "selected")

    def smaller_side(self, head: DataFrame, chosen: DataFrame) -> DataFrame:
        """(key, share): the smaller of the shares of ``chosen`` on the two sides of the head's middle."""
        middle = head.groupBy(self.key).agg(F.avg(self.side).alias("middle"))
        low = F.count_if(F.col(self.side) < F.col("middle"))
        n = F.count(F.lit(1))
        return chosen.join(middle, self.key).groupBy(self.key).agg((F.least(low, n - low) / n).alias("share"))

    def by_depth(self, grid: DataFrame, dark: bool) -> tuple[DataFrame, DataFrame]:
        """(mask, verdicts (key, refusal, selected)) of the volumes that have a head."""
        r, key = self.rules, self.key
        g = durable(grid.join(self.within(grid, F.lit(True), "low"), key).withColumn("above", F.col("v") > F.col("low")))
        above = g.where("above").select(*self.at)
        open_ = self.largest(self.filled(g, above))
        closed = above
        for _ in range(r.closing_voxels):
            closed = durable(V.dilate(closed, key, self.shape))
        head = self.largest(self.filled(g, closed))
        for _ in range(r.closing_voxels):
            head = durable(V.erode(head, key, self.shape))
        g = durable(self.flag(self.flag(g, "head", head), "open", open_))
        tissue = self.within(g, F.col("open"), "tissue")
        g = durable(g.join(tissue, key, "left"))
        fluid = F.col("v") <= F.col("low") if dark else F.col("v") > F.col("tissue")
        g = durable(self.away(g, "deep", F.col("head")).withColumn("candidate", F.col("head") & F.coalesce(fluid, F.lit(False))))
        heads = durable(g.where("head").groupBy(key).agg(F.count(F.lit(1)).alias("head_voxels"), F.count_if("candidate").alias("candidates")))
        flooded = F.col("candidates") > F.col("head_voxels") * r.most_fluid
        labels = durable(V.components(g.where("candidate"), key, self.shape).join(V.merged(g.where("candidate").select(*self.at, "deep")), self.at))
        sizes = V.sizes(labels, key, F.min("deep").alias("least")).where((F.col("size") >= r.least_voxels) & (F.col("least") >= r.depth))
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), "label"))
        chosen = sizes.withColumn("place", place).where(F.col("place") <= r.most_components)
        mask = durable(V.of_components(labels, chosen, key).join(heads.where(~flooded).select(key), key, "left_semi"))
        if dark:
            darker = F.col("open") & (F.col("v") <= F.col("tissue"))
            edge = self.within(g, darker, "edge")
            allowed = durable(g.where("head").join(edge, key).where(F.col("v") <= F.greatest("low", "edge")).select(*self.at))
            steps = tuple(int(r.growth / s + 1e-9) for s in self.mm)
            mask = durable(V.grow_limited(mask, allowed, key, self.shape, steps))
        verdict = self.finished(mask, heads).join(heads, key).withColumn("refusal", F.when(flooded, "thresholdDidNotIsolateCsf").otherwise(F.col("refusal")))
        sides = self.smaller_side(g.where("head"), mask)
        one_sided = F.col("refusal").isNull() & (F.col("share") < r.least_side)
        verdict = verdict.join(sides, key, "left").withColumn("refusal", F.when(one_sided, "oneSided").otherwise(F.col("refusal")))
        return mask, durable(verdict.select(key, "refusal", "selected"))

    def by_cores(self, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(mask, verdicts (key, refusal, selected)) of the volumes that have cores on both sides."""
        r, key = self.rules, self.key
        g = durable(grid.join(self.within(grid, F.lit(True), "low"), key).withColumn("above", F.col("v") > F.col("low")))
        near = self.away(g, "to_tissue", ~F.col("above"))
        outer = self.largest(self.filled(g, durable(near.where(F.col("above") | (F.col("to_tissue") <= r.core_closing)).select(*self.at))))
        g = self.away(durable(self.flag(g, "outer", outer)), "from_outside", F.col("outer"))
        g = durable(g.withColumn("head", F.col("from_outside") > r.core_closing).drop("outer", "from_outside"))
        g = self.away(g, "deep", F.col("head")).withColumn("candidate", F.col("head") & ~F.col("above") & (F.col("deep") >= r.depth))
        g = durable(self.away(durable(g), "thick", F.col("candidate")))
        core = g.where(F.col("candidate") & (F.col("thick") >= r.core_thickness))
        labels = durable(V.components(core, key, self.shape).join(V.merged(core.select(*self.at, "v", "deep", "low")), self.at))
        centre = [F.floor(F.avg(a)).cast("int").alias(f"c{a}") for a in AXES]
        parts = V.sizes(labels, key, F.min("deep").alias("least"), F.avg("v").alias("mean"), F.first("low").alias("low"), *centre).where(F.col("size") * self.ml >= r.core_ml)
        good = (F.col("least") >= r.core_depth) & (F.col("mean") >= F.col("low") * r.core_brightness) & (F.col("headroom") <= r.core_headroom)
        chosen = durable(V.of_components(labels, self.with_headroom(durable(parts), g.where("above")).where(good), key))
        both = self.smaller_side(g.where("head"), chosen).where(F.col("share") >= r.least_side).select(key)
        chosen = durable(chosen.join(both, key, "left_semi"))
        g = durable(self.flag(g.join(both, key, "left_semi"), "chosen", chosen))
        near = self.away(g, "near", ~F.col("chosen"))
        ventricle = self.flooded(chosen, near.where(F.col("candidate") & (F.col("near") <= r.core_growth)))
        g = durable(self.flag(g, "ventricle", ventricle))
        g = durable(self.away(g, "from_ventricle", ~F.col("ventricle")))
        shell = ~F.col("ventricle") & F.col("head") & F.col("from_ventricle").between(*r.shell)
        level = g.where("chosen").groupBy(key).agg(F.avg("v").alias("fluid"))
        half = V.SEL.quantiles(g.where(shell).select(key, "v"), [key], "v", {"tissue": V.SEL.upper_median()})
        level = level.join(half, key, "left").select(key, F.coalesce((F.col("fluid") + F.col("tissue")) / 2, "fluid").alias("boundary"))
        rim = g.join(level, key).where(F.col("head") & (F.col("v") <= F.col("boundary")) & (F.col("from_ventricle") <= r.core_rim))
        mask = durable(self.flooded(g.where("ventricle").select(*self.at), rim))
        heads = g.where("head").groupBy(key).agg(F.count(F.lit(1)).alias("head_voxels"))
        return mask, durable(self.finished(mask, heads))

    def flooded(self, seeds: DataFrame, allowed: DataFrame) -> DataFrame:
        """The seeds and what of ``allowed`` is connected to them."""
        whole = durable(seeds.select(*self.at).unionByName(allowed.select(*self.at)).distinct())
        return durable(V.reconstruct(seeds, whole, self.key, self.shape))

    def with_headroom(self, parts: DataFrame, tissue: DataFrame) -> DataFrame:
        """``parts`` with the way from their centre to the last tissue above it; infinite if that is on the frame."""
        axis, step = self.up
        n, mm = self.shape[AXES.index(axis)], self.mm[AXES.index(axis)]
        others = [a for a in AXES if a != axis]
        line = tissue.select(self.key, *[F.col(a).alias(f"c{a}") for a in others], F.col(axis).alias("t"))
        reached = F.when((F.col("t") - F.col(f"c{axis}")) * step >= 0, F.col("t"))
        last = (F.max(reached) if step > 0 else F.min(reached)).alias("t")
        found = parts.join(V.merged(line), [self.key, *[f"c{a}" for a in others]], "left").groupBy(*parts.columns).agg(last).withColumn("t", F.coalesce("t", f"c{axis}"))
        return found.withColumn("headroom", F.when(F.col("t").isin(0, n - 1), F.lit(math.inf)).otherwise(F.abs(F.col("t") - F.col(f"c{axis}")) * mm)).drop("t")

    def sigmas(self) -> V.Triple:
        """Of each axis, in voxels, what smooths its spacing to the wanted width at half maximum; 0 where it is not finer."""
        return tuple(s if s >= 0.3 else 0.0 for s in (math.sqrt(max(0.0, self.rules.smoothing**2 - m * m)) / 2.3548 / m for m in self.mm))

    def by_smoothed_cores(self, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The cores of the smoothed volumes, without those near the frame."""
        if not any(self.sigmas()):
            none = grid.limit(0)
            return none.select(*self.at), none.select(self.key, F.lit("").alias("refusal"), F.lit(0).cast("long").alias("selected"))
        mask, verdicts = self.by_cores(durable(V.gaussian(grid, self.key, "v", self.sigmas())))
        margin = F.least(*[F.min(F.least(F.col(a), n - 1 - F.col(a))) * s for a, n, s in zip(AXES, self.shape, self.mm)])
        far = mask.groupBy(self.key).agg(margin.alias("margin")).where(F.col("margin") >= self.rules.smoothed_margin).select(self.key)
        return mask.join(far, self.key, "left_semi"), verdicts.join(far, self.key, "left_semi")


def segment(grid: DataFrame, key: str, value: str, shape: V.Shape, mm: V.Triple, dark: bool = True, rules: Rules = Rules(), side: str = "x", up: tuple[str, int] = ("z", 1)) -> tuple[DataFrame, DataFrame]:
    """(mask (key, x, y, z), verdicts (key, path, refusal)): of each volume its path, or the refusal of all; ``noHead`` for one without
    a head above the background."""
    h = Heads(key, shape, mm, rules, side, up)
    g = durable(grid.select(key, *AXES, F.col(value).cast("double").alias("v")))
    mask, depth = h.by_depth(g, dark)
    done = depth.where("refusal IS NULL").select(key, F.lit("depth").alias("path"))
    parts = [mask.join(done.select(key), key, "left_semi")]
    refused = depth.where("refusal IS NOT NULL").select(key, "refusal", "selected")
    if dark:
        for name, path in (("cores", h.by_cores), ("smoothedCores", h.by_smoothed_cores)):
            rest = durable(g.join(refused.select(key).join(done.select(key), key, "left_anti"), key, "left_semi"))
            if rest.isEmpty():
                break
            mask, verdicts = path(rest)
            found = verdicts.where("refusal IS NULL").select(key, F.lit(name).alias("path"))
            parts.append(mask.join(found.select(key), key, "left_semi"))
            done = durable(done.unionByName(found))
            if name == "cores":
                own = verdicts.where("refusal IS NOT NULL").select(key, F.col("refusal").alias("own"))
                refused = durable(refused.join(own, key, "left").select(key, F.when(F.col("selected") == 0, F.coalesce("own", "refusal")).otherwise(F.col("refusal")).alias("refusal"), "selected"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    every = g.select(key).distinct().join(done, key, "left").join(refused.select(key, "refusal"), key, "left").join(depth.select(key, F.lit(True).alias("headed")), key, "left")
    refusal = F.when(F.col("path").isNotNull(), None).otherwise(F.when(F.col("headed").isNull(), "noHead").otherwise(F.col("refusal")))
    return durable(whole), durable(every.select(key, "path", refusal.alias("refusal")))
