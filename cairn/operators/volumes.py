"""Volumes and masks in long form: one row a voxel, (key columns, x, y, z, value).

A volume's voxels are rows of a table, so one large volume is worked on by many tasks. Neighbourhoods are exploded
offsets met by grouping or semi joins; what is separable runs along the lines of one axis after the other, where a
group is one line; connectivity is settled over the links of runs. ``shape`` is (nx, ny, nz), ``spacing`` (sx, sy, sz)
in mm. Masks are tables of their voxels' distinct coordinates. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import histograms as HG
from . import selection as SEL
from .graph import connected_components
from .store import durable

AXES = ("x", "y", "z")
Shape = tuple[int, int, int]
Triple = tuple[float, float, float]
#: Face neighbours.
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def disc(radius: float) -> tuple[Shape, ...]:
    """Offsets within a slice whose chamfer length (steps of 1 and the root of 2) is ``radius`` at most, without the centre."""
    r = int(radius)
    length = lambda dx, dy: max(dx, dy) + (2**0.5 - 1) * min(dx, dy)
    return tuple((dx, dy, 0) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if (dx or dy) and length(abs(dx), abs(dy)) <= radius)


def inside(shape: Shape) -> Column:
    x, y, z = (F.col(a).between(0, n - 1) for a, n in zip(AXES, shape))
    return x & y & z


def on_border(shape: Shape) -> Column:
    x, y, z = (F.col(a).isin(0, n - 1) for a, n in zip(AXES, shape))
    return x | y | z


def merged(voxels: DataFrame) -> DataFrame:
    """``voxels`` for a join by coordinates or labels, which is to be a merge: stored, they take far less than in memory, and by
    that size Catalyst would send them through the driver to every executor."""
    return voxels.hint("merge")


def _moved(mask: DataFrame, key: str, offsets, *more: Column) -> DataFrame:
    """A row for each voxel and offset; o is the offset's number."""
    at = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("z") + dz).alias("z"), F.lit(i).alias("o")) for i, (dx, dy, dz) in enumerate(offsets)])
    return mask.select(key, *more, F.inline(at))


def dilate(mask: DataFrame, key: str, shape: Shape, within: DataFrame | None = None, offsets=FACES) -> DataFrame:
    """The mask and its neighbours in the volume; with ``within``, only neighbours that are voxels of it."""
    if not offsets:
        return mask.select(key, *AXES)
    near = _moved(mask, key, offsets).where(inside(shape)).select(key, *AXES).distinct()
    if within is not None:
        near = near.join(merged(within.select(key, *AXES)), [key, *AXES], "left_semi")
    return mask.select(key, *AXES).unionByName(near).distinct()


def erode(mask: DataFrame, key: str, shape: Shape, keep_border: bool = True, offsets=FACES) -> DataFrame:
    """Voxels whose neighbours are all in the mask; what lies outside the volume counts as ``keep_border`` says."""
    met = _moved(mask, key, ((0, 0, 0), *offsets)).groupBy(key, *AXES).agg(F.bool_or(F.col("o") == 0).alias("own"), (F.count(F.lit(1)) - 1).alias("n"))
    there = [inside_of.cast("int") for inside_of in (_shifted_inside(shape, o) for o in offsets)]
    wanted = sum(there, F.lit(0)) if keep_border else F.lit(len(offsets))
    return met.where(F.col("own") & (F.col("n") == wanted)).select(key, *AXES)


def _shifted_inside(shape: Shape, offset: Shape) -> Column:
    x, y, z = ((F.col(a) - d).between(0, n - 1) for a, d, n in zip(AXES, offset, shape))
    return x & y & z


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Neighbours within a slice.
PLANE4 = tuple(o for o in FACES if not o[2])
PLANE8 = tuple((dx, dy, 0) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)
#: Voxels of a slab, which one task labels at once, and links of a volume's slabs that one task settles.
SLAB, LINKS = 1 << 18, 1 << 18


def _slab_labels(places: np.ndarray, rows: np.ndarray, shape: Shape, depth: int, ahead: list[Shape]) -> np.ndarray:
    """For each voxel (row of its slab, place x + nx (y + ny z) within it) the first voxel of its component, by number."""
    nx, ny, _ = shape
    size = nx * ny * depth
    number = np.full((int(rows[-1]) + 1) * size if len(rows) else 0, -1, np.int32)
    number[rows * size + places] = np.arange(len(places))
    x, y, z = places % nx, places // nx % ny, places // (nx * ny)
    links = []
    for dx, dy, dz in ahead:
        there = np.flatnonzero((x + dx >= 0) & (x + dx < nx) & (y + dy >= 0) & (y + dy < ny) & (z + dz < depth))
        other = number[rows[there] * size + places[there] + dx + nx * (dy + ny * dz)]
        links.append(np.stack([there[other >= 0], other[other >= 0]]))
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    return _least_reachable(len(places), a, b)


def components(mask: DataFrame, key: str, shape: Shape, offsets: tuple[Shape, ...] = FACES) -> DataFrame:
    """(key, x, y, z, label): components by the neighbours ``offsets``; a label is 1 + the smallest place x + nx (y + ny z) in it.

    A volume is cut into slabs of slices of about ``SLAB`` voxels, each labelled by one task. Labels that touch across
    two slabs are linked by a join; the links of a volume are settled in one group while they are at most ``LINKS``, and
    over the cluster, by grouped minima, where they are more. A volume of one slab has no links.
    """
    nx, ny, nz = shape
    depth = max(1, min(nz, SLAB // max(1, nx * ny)))
    ahead = [o for o in offsets if o[::-1] > (0, 0, 0)]
    kind = mask.schema[key].dataType.simpleString()
    place = F.col("x") + nx * (F.col("y") + ny * (F.col("z") % depth))
    slabs = mask.groupBy(key, F.floor(F.col("z") / depth).cast("long").alias("slab")).agg(F.array_sort(F.collect_set(place.cast("int"))).alias("places"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 4 * SLAB // max(1, nx * ny * depth))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(2)
                places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                first = _slab_labels(places, rows, shape, depth, ahead)
                base = part.column(1).to_numpy(zero_copy_only=False)[rows] * (nx * ny * depth)
                whole = places + base
                columns = (whole % nx, whole // nx % ny, whole // (nx * ny), whole[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *(pa.array(c.astype(np.int32)) for c in columns[:3]), pa.array(columns[3])], [key, *AXES, "node"])

    labelled = slabs.mapInArrow(label, f"`{key}` {kind}, x int, y int, z int, node long")
    across = [o for o in ahead if o[2]]
    if depth >= nz or not across:
        return labelled.select(key, *AXES, (F.col("node") + 1).alias("label"))
    labelled = durable(labelled)
    edge = labelled.where(F.col("z") % depth == depth - 1)
    met = _moved(edge, key, across, F.col("node").alias("a")).drop("o").join(merged(labelled.where(F.col("z") % depth == 0)), [key, *AXES])
    links = durable(met.select(key, "a", F.col("node").alias("b")).distinct())
    many = links.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LINKS).select(key)

    def settle(table: pa.Table) -> pa.Table:
        a, b = (np.asarray(table.column(i)) for i in (1, 2))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = node[_least_reachable(len(node), at[: len(a)], at[len(a):])]
        return pa.table([pa.repeat(table.column(0)[0], len(node)), pa.array(node), pa.array(root)], names=[key, "node", "root"])

    few = links.join(many, key, "left_anti").groupBy(key).applyInArrow(settle, f"`{key}` {kind}, node long, root long")
    ends = links.join(many, key, "left_semi").select(*(F.struct(F.col(key).alias("k"), F.col(n).alias("node")).alias(n) for n in "ab"))
    if not many.isEmpty():
        few = few.unionByName(connected_components(ends).select(F.col("node.k").alias(key), F.col("node.node").alias("node"), F.col("component.node").alias("root")))
    return labelled.join(merged(few), [key, "node"], "left").select(key, *AXES, (F.coalesce("root", "node") + 1).alias("label"))


def sizes(labels: DataFrame, key: str, *more: Column) -> DataFrame:
    return labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("size"), *more)


def largest(labels: DataFrame, key: str) -> DataFrame:
    """(key, label, size) of each volume's largest component, the first on a tie."""
    best = sizes(labels, key).groupBy(key).agg(F.min_by(F.struct("label", "size"), F.struct(-F.col("size"), "label")).alias("b"))
    return best.select(key, "b.label", "b.size")


def of_components(labels: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The voxels of the chosen (key, label)."""
    return labels.join(chosen.select(key, "label"), [key, "label"], "left_semi").select(key, *AXES)


def reconstruct(seeds: DataFrame, within: DataFrame, key: str, shape: Shape, offsets: tuple[Shape, ...] = FACES) -> DataFrame:
    """What of ``within`` is connected to a seed in it."""
    labels = durable(components(within, key, shape, offsets))
    return of_components(labels, merged(labels.join(merged(seeds.select(key, *AXES)), [key, *AXES], "left_semi").select(key, "label").distinct()), key)


def fill_outside(grid: DataFrame, mask: DataFrame, key: str, shape: Shape) -> DataFrame:
    """The mask with its holes: all voxels of ``grid`` that a flood of the background from the border does not reach."""
    background = durable(grid.select(key, *AXES).join(merged(mask.select(key, *AXES)), [key, *AXES], "left_anti"))
    return grid.select(key, *AXES).join(merged(reconstruct(background.where(on_border(shape)), background, key, shape)), [key, *AXES], "left_anti")


def along(df: DataFrame, key: str, axis: str, value: str, line: Callable[[Column], Column]) -> DataFrame:
    """``line`` applied to the values of every line of one axis, in order; its results are numbered from 0."""
    others = [a for a in AXES if a != axis]
    held = df.groupBy(key, *others).agg(F.array_sort(F.collect_list(F.struct(axis, value)))[value].alias("values"))
    return held.select(key, *others, F.posexplode(line(F.col("values"))).alias(axis, value)).select(key, *AXES, value)


def _envelope(own: list[float], step: float) -> list[float]:
    """min over j of own[j] + (step (i - j))^2 for each i: the lower envelope of parabolas, in linear time."""
    at, begins = [], []
    square = step * step
    for j, height in enumerate(own):
        if height == math.inf:
            continue
        while at:
            k = at[-1]
            meet = (height - own[k]) / (2 * square * (j - k)) + (j + k) / 2  # where j's parabola goes below k's
            if meet > begins[-1]:
                break
            at.pop()
            begins.pop()
        begins.append(meet if at else -math.inf)
        at.append(j)
    if not at:
        return own
    out, k = [], 0
    for i in range(len(own)):
        while k + 1 < len(at) and begins[k + 1] < i:
            k += 1
        d = (i - at[k]) * step
        out.append(own[at[k]] + d * d)
    return out


def _envelopes(df: DataFrame, key: str, fixed: str, passes: list[tuple[str, float]]) -> DataFrame:
    """The column mm of a full grid after passes along axes of the slices where ``fixed`` is the same; a slice is a row."""
    inner = [a for a in AXES if a != fixed][::-1]
    kind = df.schema[key].dataType.simpleString()
    slices = df.groupBy(key, fixed).agg(F.array_sort(F.collect_list(F.struct(*inner, "mm"))).alias("s")).select(key, fixed, *(F.col("s")[a].alias(a) for a in inner), F.col("s")["mm"].alias("mm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            outer, nearer = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            values = batch.column(4).flatten().to_numpy(zero_copy_only=False).copy()
            begin = 0
            for size in sizes.tolist():
                part = slice(begin, begin + size)
                wide = int(nearer[part].max()) + 1
                plane = values[part].reshape(-1, wide)
                for axis, step in passes:
                    plane = plane.T if axis == inner[0] else plane
                    for i, line in enumerate(plane.tolist()):
                        if any(line):
                            plane[i] = _envelope(line, step)
                    plane = plane.T if axis == inner[0] else plane
                begin += size
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            columns = {key: batch.column(0).take(rows), fixed: batch.column(1).take(rows).cast(pa.int32()), inner[0]: pa.array(outer.astype(np.int32)), inner[1]: pa.array(nearer.astype(np.int32)), "mm": pa.array(values)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in (key, *AXES, "mm")], [key, *AXES, "mm"])

    return slices.mapInArrow(run, f"`{key}` {kind}, x int, y int, z int, mm double")


def distance(grid: DataFrame, key: str, mask: str, spacing: Triple) -> DataFrame:
    """(key, x, y, z, mm): the Euclidean distance of each voxel of the full ``grid`` to the nearest one where the boolean
    ``mask`` is false; infinite where a volume has none. Lower envelopes along x and y of each slice, then along z, in
    time linear in the voxels."""
    sx, sy, sz = spacing
    d = grid.select(key, *AXES, F.when(F.col(mask), F.lit(math.inf)).otherwise(0.0).alias("mm"))
    d = _envelopes(d, key, "z", [("x", sx), ("y", sy)])
    return _envelopes(d, key, "y", [("z", sz)]).withColumn("mm", F.sqrt("mm"))


def gaussian(df: DataFrame, key: str, value: str, sigma: Triple) -> DataFrame:
    """Smoothing axis by axis to three sigma, renormalised at the edges; axes with sigma below 0.3 stay."""
    for axis, s in zip(AXES, sigma):
        if s < 0.3:
            continue
        radius = math.ceil(3 * s)

        def line(v: Column, s: float = s, radius: int = radius) -> Column:
            def smooth(i: Column) -> Column:
                first = F.greatest(i - radius, F.lit(0))
                part = F.slice(v, first + 1, i + radius + 1 - first)
                weighted = F.transform(part, lambda w, j: F.struct((w * _bell(first + j - i, s)).alias("v"), _bell(first + j - i, s).alias("w")))
                total = F.aggregate(weighted, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda a, b: F.struct((a["v"] + b["v"]).alias("v"), (a["w"] + b["w"]).alias("w")))
                return total["v"] / total["w"]

            return F.transform(v, lambda own, i: smooth(i))

        df = along(df, key, axis, value, line)
    return df


def _bell(offset: Column, s: float) -> Column:
    return F.exp(-(offset * offset) / F.lit(2 * s * s))


def resample(df: DataFrame, key: str, value: str, shape: Shape, spacing: Triple, target: float, most: int = 512**3) -> DataFrame:
    """Trilinear samples on an isotropic grid, coordinates clamped at the edges; axes already on it stay."""
    counts = [max(1, math.floor((n - 1) * s / target) + 1) for n, s in zip(shape, spacing)]
    if math.prod(counts) > most:
        raise ValueError("the resampled volume has too many voxels")
    for axis, n, s, to in zip(AXES, shape, spacing, counts):
        if s == target:
            continue

        def line(v: Column, n: int = n, s: float = s, to: int = to) -> Column:
            def sample(k: Column) -> Column:
                at = F.least(k * F.lit(target) / s, F.lit(n - 1.0))
                low = F.floor(at).cast("int")
                return F.get(v, low) * (1 - (at - low)) + F.get(v, F.least(low + 1, F.lit(n - 1))) * (at - low)

            return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), sample)

        df = along(df, key, axis, value, line)
    return df


def _looked_up(df: DataFrame, key: str, value: str, counts: Shape, place: Callable[[Column, int], Column], shape: Shape) -> DataFrame:
    """Nearest values at place(k, axis number) for k below the axis's count; 0 outside the volume."""
    for number, axis in enumerate(AXES):
        def line(v: Column, number: int = number) -> Column:
            def pick(k: Column) -> Column:
                at = place(k, number).cast("int")
                return F.when(at.between(0, shape[number] - 1), F.get(v, at)).otherwise(F.lit(0).cast(df.schema[value].dataType))

            return F.transform(F.sequence(F.lit(0), F.lit(counts[number] - 1)), pick)

        df = along(df, key, axis, value, line)
    return df


def conform(df: DataFrame, key: str, value: str, shape: Shape, spacing: Triple, side: int, cut_share: float = 0.001) -> DataFrame:
    """A cube of ``side`` voxels of 1 mm around the volume's centre, scaled to 0..255 from the least value to the one
    that all but ``cut_share`` of the filled voxels reach; zero stays zero, outside is 0."""
    v = F.col(value)
    values = df.select(key, *AXES, value, v.cast("double").alias("__v"))
    limits = durable(values.groupBy(key).agg(F.count("__v").alias("n"), F.count_if(v > 0).alias("filled"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).where("n > 0"))
    rank = F.col("n") - 1 - F.floor(F.col("filled") * cut_share)
    high = SEL.at_ranks(values.select(key, "__v").where("__v IS NOT NULL"), [key], limits.select(key, F.lit("high").alias("target"), rank.alias("rank"), "n", "lo", "hi"))
    bounds = limits.select(key, F.col("lo").alias("low")).join(high.select(key, F.col("value").alias("high")), key)
    factor = 255 / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    scaled = F.least(F.greatest(F.rint((v - F.col("low")) * factor), F.lit(0.0)), F.lit(255.0))
    scaled = values.join(bounds, key).select(key, *AXES, F.when(v == 0, 0.0).otherwise(scaled).alias(value))
    return _looked_up(scaled, key, value, (side,) * 3, lambda t, a: F.rint((t - (side - 1) / 2) / F.lit(spacing[a]) + (shape[a] - 1) / 2), shape)


def project_back(df: DataFrame, key: str, value: str, side: int, shape: Shape, spacing: Triple) -> DataFrame:
    """Labels of a conformed cube on the original grid, by the nearest voxel; outside the cube is 0."""
    return _looked_up(df, key, value, shape, lambda i, a: F.rint((i - (shape[a] - 1) / 2) * F.lit(spacing[a]) + (side - 1) / 2), (side,) * 3)


def _chamfer(off: np.ndarray, pixel: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """The chamfer length (steps of a pixel's width, height and diagonal) from each pixel of a slice to the nearest one that is set, in two passes."""
    d = np.where(off, 0.0, np.inf)
    (wide, high), diagonal = pixel, math.hypot(*pixel)
    at = np.arange(d.shape[1], dtype=float) * wide
    for rows in (range(len(d)), range(len(d) - 1, -1, -1)):
        above = None
        for y in rows:
            row = d[y]
            if above is not None:
                row = np.minimum(row, above + high)
                row[1:] = np.minimum(row[1:], above[:-1] + diagonal)
                row[:-1] = np.minimum(row[:-1], above[1:] + diagonal)
            row = np.minimum.accumulate(row - at) + at
            row = (np.minimum.accumulate((row + at)[::-1]))[::-1] - at
            d[y] = above = row
    return d


def opened(mask: DataFrame, key: str, shape: Shape, radius: float, pixel: tuple[float, float] = (1.0, 1.0), at_least: bool = False) -> DataFrame:
    """Opening per slice: voxels within the chamfer length ``radius`` of one whose surroundings so far are all mask (with
    ``at_least``, that is ``radius`` or more from the rest); what lies outside the slice counts as mask. Lengths are in
    units of ``pixel``. A slice is one row, and a length takes two passes over it, whatever the radius."""
    nx, ny, _ = shape
    kind = mask.schema[key].dataType.simpleString()
    rows = mask.groupBy(key, "z").agg(F.collect_set((F.col("x") + nx * F.col("y")).cast("int")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, places in enumerate(batch.column(2)):
                own = np.zeros(nx * ny, bool)
                own[np.asarray(places.values)] = True
                core = own & (_chamfer(~own.reshape(ny, nx), pixel).ravel() > radius + (-1e-9 if at_least else 1e-9))
                kept = np.flatnonzero(own & (_chamfer(core.reshape(ny, nx), pixel).ravel() <= radius + 1e-9)) if core.any() else found[0]
                found.append(kept)
                owner.append(np.full(len(kept), k))
            at, of = np.concatenate(found), pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array((at % nx).astype(np.int32)), pa.array((at // nx).astype(np.int32)), batch.column(1).take(of).cast(pa.int32())], [key, *AXES])

    return rows.mapInArrow(run, f"`{key}` {kind}, x int, y int, z int")


def between_bright(df: DataFrame, key: str, value: str, bright: float) -> DataFrame:
    """The voxels between the first and last one above ``bright`` of their line along x."""
    w = Window.partitionBy(key, "y", "z")
    place = F.when(F.col(value) > bright, F.col("x"))
    return df.withColumns({"first_bright": F.min(place).over(w), "last_bright": F.max(place).over(w)}).where("x BETWEEN first_bright AND last_bright").drop("first_bright", "last_bright")


def grow_limited(seeds: DataFrame, allowed: DataFrame, key: str, shape: Shape, steps: Shape) -> DataFrame:
    """A mask grown into allowed voxels, so many steps along each axis."""
    for k in range(max(steps)):
        ways = [o for o in FACES if k < max(abs(d) * n for d, n in zip(o, steps))]
        seeds = dilate(seeds, key, shape, allowed, ways)
    return seeds


def head_mask(grid: DataFrame, key: str, value: str, shape: Shape) -> DataFrame:
    """The largest component above each volume's Otsu threshold, holes filled; nothing for a uniform volume."""
    threshold = HG.otsu(grid, key, value).select(key, "threshold")
    labels = durable(components(grid.join(threshold, key).where(F.col(value) > F.col("threshold")), key, shape))
    return fill_outside(grid, of_components(labels, largest(labels, key), key), key, shape)


def segment(grid: DataFrame, key: str, value: str, shape: Shape, spacing: Triple, least_depth: float = 1.0, least_size: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dark cores inside the head: (mask, verdicts, head).

    Of the components of voxels darker than the head's mean those deep and large enough are good; the two largest are
    grown by a step into dark head voxels at or below 0. ``verdicts`` (key, refusal) name the first step that found
    nothing in a volume, null where none did.
    """
    head = durable(head_mask(grid, key, value, shape))
    there = grid.select(key, *AXES, value).join(merged(head.withColumn("in_head", F.lit(True))), [key, *AXES], "left").withColumn("in_head", F.coalesce("in_head", F.lit(False)))
    depth = distance(there, key, "in_head", spacing)
    mean = there.where("in_head").groupBy(key).agg(F.avg(value).alias("mean"))
    inner = durable(there.where("in_head").join(mean, key).join(merged(depth), [key, *AXES]).select(key, *AXES, value, "mean", F.least("mm", F.lit(1e9)).alias("mm")))
    dark = inner.where(F.col(value) < F.col("mean"))
    labels = durable(components(dark, key, shape).join(merged(inner.select(key, *AXES, "mm")), [key, *AXES]))
    found = sizes(labels, key, F.max("mm").alias("deepest")).where((F.col("deepest") >= least_depth) & (F.col("size") >= least_size))
    best = durable(found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), "label"))).where("n <= 2"))
    core = of_components(labels, best, key)
    mask = dilate(core, key, shape, dark.where(F.col(value) <= 0))
    has = lambda df, name: df.select(key, F.lit(True).alias(name)).distinct()
    state = grid.select(key).distinct().join(has(head, "h"), key, "left").join(has(labels, "d"), key, "left").join(has(best, "g"), key, "left")
    refusal = F.when(F.col("g"), None).when(F.col("h").isNull(), "noHead").when(F.col("d").isNull(), "noDarkRegion").otherwise("noDeepComponent")
    return durable(mask), state.select(key, refusal.alias("refusal")), head


def line_extents(mask: DataFrame, key: str) -> DataFrame:
    """(key, z, y, width): the extent of the mask along x on each line that has voxels."""
    return mask.groupBy(key, "z", "y").agg((F.max("x") - F.min("x") + 1).alias("width"))
