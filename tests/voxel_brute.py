"""Voxel operators as dense numpy arrays [volume, slice, row, column]: what the long-form operators are held against."""

from __future__ import annotations

import numpy as np

NEIGHBOURS = [(1, 1), (1, -1), (2, 1), (2, -1), (3, 1), (3, -1)]


def shifted(a: np.ndarray, axis: int, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    to, of = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    to[axis], of[axis] = (slice(1, None), slice(None, -1)) if by > 0 else (slice(None, -1), slice(1, None))
    out[tuple(to)] = a[tuple(of)]
    return out


def dilate(mask: np.ndarray, within: np.ndarray | None = None, neighbours=NEIGHBOURS) -> np.ndarray:
    out = mask.copy()
    for axis, by in neighbours:
        out |= shifted(mask, axis, by, False)
    return out if within is None else out & (within | mask)


def erode(mask: np.ndarray, keep_border: bool = True, neighbours=NEIGHBOURS) -> np.ndarray:
    """Voxels whose neighbours are all in the mask; what lies outside the volume counts as ``keep_border`` says."""
    out = mask.copy()
    for axis, by in neighbours:
        out &= shifted(mask, axis, by, keep_border)
    return out


def label(mask: np.ndarray, neighbours=NEIGHBOURS) -> np.ndarray:
    """Components by face neighbours: each voxel gets 1 + the smallest index of its component, 0 outside."""
    big = np.int64(mask[0].size + 1)
    start = np.broadcast_to(np.arange(1, mask[0].size + 1).reshape(mask.shape[1:]), mask.shape)
    out = np.where(mask, start, big)
    while True:
        low = out.copy()
        for axis, by in neighbours:
            low = np.minimum(low, shifted(out, axis, by, big))
        low = np.where(mask, low, big)
        if (low == out).all():
            return np.where(mask, out, 0)
        out = low


def sizes(labels: np.ndarray) -> np.ndarray:
    """[volume, label] -> number of voxels."""
    n, width = len(labels), labels[0].size + 1
    flat = labels.reshape(n, -1) + np.arange(n)[:, None] * width
    return np.bincount(flat.ravel(), minlength=n * width).reshape(n, width)


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest component of each volume, the first on a tie."""
    labels = label(mask)
    count = sizes(labels)
    count[:, 0] = 0
    best = count.argmax(axis=1)
    return (labels == best[:, None, None, None]) & mask


def border(shape: tuple[int, ...]) -> np.ndarray:
    edge = np.ones(shape, bool)
    edge[tuple(slice(1, -1) for _ in shape)] = False
    return edge


def reconstruct(seed: np.ndarray, within: np.ndarray) -> np.ndarray:
    """What of ``within`` is connected to the seed."""
    out = seed & within
    while True:
        grown = dilate(out, within) & within
        if (grown == out).all():
            return out
        out = grown


def fill_outside(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: all that a flood of the background from the border does not reach."""
    return ~reconstruct(~mask & border(mask.shape[1:]), ~mask)


def distance(mask: np.ndarray, spacing: tuple[float, float, float]) -> np.ndarray:
    """The Euclidean distance of each voxel to the nearest one outside the mask, one axis after the other; infinite
    where a volume has no outside."""
    squared = np.where(mask, np.inf, 0.0)
    for axis, step in zip((1, 2, 3), spacing):
        line = np.moveaxis(squared, axis, -1)
        n = line.shape[-1]
        apart = ((np.arange(n)[:, None] - np.arange(n)[None, :]) * step) ** 2
        best = np.full_like(line, np.inf)
        for k in range(n):  # one site at a time: memory stays that of one volume batch
            best = np.minimum(best, line[..., k: k + 1] + apart[k])
        squared = np.moveaxis(best, -1, axis)
    return np.sqrt(squared)


def gaussian(v: np.ndarray, sigma: tuple[float, float, float]) -> np.ndarray:
    """Smoothing axis by axis to three sigma, renormalised at the edges; axes with sigma below 0.3 stay."""
    for axis, s in zip((1, 2, 3), sigma):
        if s < 0.3:
            continue
        radius = int(np.ceil(3 * s))
        n = v.shape[axis]
        offset = np.arange(n)[:, None] - np.arange(n)[None, :]
        kernel = np.where(np.abs(offset) <= radius, np.exp(-(offset**2) / (2 * s * s)), 0.0)
        kernel /= kernel.sum(axis=1, keepdims=True)
        v = np.moveaxis(np.moveaxis(v, axis, -1) @ kernel.T, -1, axis)
    return v


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Per slice, the two-pass chamfer distance (steps of 1 and the root of 2) to what is outside the mask."""
    d = np.where(mask, 1e9, 0.0)
    rows, columns = mask.shape[2:]
    diagonal = 2**0.5
    for sign in (1, -1):
        for y in range(rows)[::sign]:
            for x in range(columns)[::sign]:
                for dy, dx, cost in ((0, -1, 1.0), (-1, 0, 1.0), (-1, -1, diagonal), (-1, 1, diagonal)):
                    yy, xx = y + sign * dy, x + sign * dx
                    if 0 <= yy < rows and 0 <= xx < columns:
                        d[:, :, y, x] = np.minimum(d[:, :, y, x], d[:, :, yy, xx] + cost)
    return d


def opened(mask: np.ndarray, radius: float) -> np.ndarray:
    """Opening per slice by the chamfer distance."""
    core = chamfer(mask) > radius
    return (chamfer(~core) <= radius) & mask


def resample(v: np.ndarray, spacing: tuple[float, float, float], target: float, most: int = 512**3) -> np.ndarray:
    """Trilinear samples on an isotropic grid, coordinates clamped at the edges."""
    shape = [max(1, int(np.floor((n - 1) * s / target)) + 1) for n, s in zip(v.shape[1:], spacing)]
    if int(np.prod(shape)) > most:
        raise ValueError("the resampled volume has too many voxels")
    for axis, (n, s) in enumerate(zip(shape, spacing), 1):
        at = np.clip(np.arange(n) * target / s, 0, v.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, v.shape[axis] - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(v.ndim)])
        v = np.take(v, low, axis) * (1 - part) + np.take(v, high, axis) * part
    return v


def conform(v: np.ndarray, spacing: tuple[float, float, float], side: int) -> np.ndarray:
    """A cube of ``side`` voxels of 1 mm around the volume's centre, robustly scaled to 0..255; outside is 0."""
    flat = v.reshape(len(v), -1)
    low = flat.min(axis=1)
    ordered = np.sort(flat, axis=1)
    filled = (flat > 0).sum(axis=1)
    high = ordered[np.arange(len(v)), flat.shape[1] - 1 - np.floor(0.001 * filled).astype(int)]
    scaled = np.clip(np.rint((v - low[:, None, None, None]) * (255 / np.maximum(high - low, 1e-12))[:, None, None, None]), 0, 255)
    scaled = np.where(v == 0, 0, scaled)
    inside = np.ones((len(v), side, side, side), bool)
    for axis, s in zip((1, 2, 3), spacing):
        at = (np.arange(side) - (side - 1) / 2) / s + (v.shape[axis] - 1) / 2
        index = np.rint(at).astype(int)
        good = (index >= 0) & (index < v.shape[axis])
        scaled = np.take(scaled, np.clip(index, 0, v.shape[axis] - 1), axis)
        inside &= good.reshape([-1 if k == axis else 1 for k in range(4)])
    return np.where(inside, scaled, 0)


def project_back(labels: np.ndarray, spacing: tuple[float, float, float], shape: tuple[int, int, int]) -> np.ndarray:
    """Labels of a conformed cube on the original grid, by the nearest voxel; outside the cube is 0."""
    side, inside = labels.shape[1], np.ones((len(labels), *shape), bool)
    for axis, (n, s) in enumerate(zip(shape, spacing), 1):
        index = np.rint((np.arange(n) - (n - 1) / 2) * s + (side - 1) / 2).astype(int)
        inside &= ((index >= 0) & (index < side)).reshape([-1 if k == axis else 1 for k in range(4)])
        labels = np.take(labels, np.clip(index, 0, side - 1), axis)
    return np.where(inside, labels, 0)


def otsu_thresholds(v: np.ndarray, bins: int = 256) -> np.ndarray:
    """One threshold of each volume; nan for a uniform one."""
    out = np.full(len(v), np.nan)
    for i, x in enumerate(v.reshape(len(v), -1)):
        lo, hi = x.min(), x.max()
        if hi <= lo:
            continue
        n = np.bincount(((x - lo) / (hi - lo) * (bins - 1)).astype(int), minlength=bins).astype(float)
        below, weighted = np.cumsum(n), np.cumsum(n * np.arange(bins))
        above = len(x) - below
        with np.errstate(divide="ignore", invalid="ignore"):
            variance = np.where((below > 0) & (above > 0), below * above * (weighted / below - (weighted[-1] - weighted) / above) ** 2, -1.0)
        out[i] = lo + (int(variance.argmax()) + 1) * (hi - lo) / bins
    return out


def grow_limited(seed: np.ndarray, v: np.ndarray, limit: float, steps: tuple[int, int, int]) -> np.ndarray:
    """A mask grown into voxels at or below a boundary, so many steps along each axis."""
    out, allowed = seed.copy(), v <= limit
    for k in range(max(steps)):
        ways = [n for n in NEIGHBOURS if k < steps[n[0] - 1]]
        out = dilate(out, allowed, ways)
    return out


def segment(v: np.ndarray, spacing: tuple[float, float, float], least_depth: float = 1.0, least_size: int = 2) -> tuple[np.ndarray, list[str | None]]:
    """Dark cores inside the head: Otsu head mask, holes filled, dark voxels, components deep and large enough, the two
    largest of them grown into what is nearly as dark. Each volume has a refusal code where a step finds nothing."""
    head = fill_outside(largest(v > otsu_thresholds(v)[:, None, None, None]))
    depth = distance(head, spacing)
    mean = np.array([x[m].mean() if m.any() else np.nan for x, m in zip(v, head)])
    dark = head & (v < mean[:, None, None, None])
    labels = label(dark)
    count = sizes(labels)
    out, codes = np.zeros_like(head), []
    for i in range(len(v)):
        deepest = {k: np.where(np.isinf(d := depth[i][labels[i] == k]), 1e9, d).max() for k in np.unique(labels[i]) if k}
        good = sorted((k for k in deepest if deepest[k] >= least_depth and count[i, k] >= least_size), key=lambda k: (-count[i, k], k))
        for k in good[:2]:
            out[i] |= labels[i] == k
        codes.append(None if good else "noHead" if not head[i].any() else "noDarkRegion" if not dark[i].any() else "noDeepComponent")
    edge = np.where(np.isnan(mean), 0, mean)[:, None, None, None]
    return out & head | grow_limited(out, np.where(head, v, np.inf), 0.0, (1, 1, 1)) & head & (v < edge), codes


def widest_line(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each volume the largest extent of the mask along the column axis, with its slice and row."""
    x = np.arange(mask.shape[3])
    first = np.where(mask, x, mask.shape[3]).min(axis=3)
    last = np.where(mask, x, -1).max(axis=3)
    width = np.maximum(last - first + 1, 0).reshape(len(mask), -1)
    best = width.argmax(axis=1)
    return width[np.arange(len(mask)), best], best // mask.shape[2], best % mask.shape[2]
