"""The segmentation paths of one dense volume [z, y, x], step by step; what the long form is held against."""

from __future__ import annotations

import math

import numpy as np

from . import voxel_brute as K


def one(f, *arrays, **named):
    return f(*(a[None] for a in arrays), **named)[0]


def otsu(values):
    """The threshold of a list of values, None where they are all the same."""
    if not len(values) or values.min() == values.max():
        return None
    return float(K.otsu_thresholds(values.reshape(1, 1, 1, -1))[0])


def components(mask):
    labels = one(K.label, mask)
    return [labels == k for k in np.unique(labels) if k]


def distance(inside, mm):
    return K.distance(inside[None], mm)[0]


def flood(seeds, allowed):
    return one(K.reconstruct, seeds, allowed | seeds)


def verdict(mask, head, rules, ml):
    n = int(mask.sum())
    if n > head.sum() * rules.most_fluid:
        return "thresholdDidNotIsolateCsf"
    if (mask & K.border(mask.shape)).any():
        return "truncatedByFrame"
    return "notFound" if not n else "implausiblySmall" if n * ml < rules.least_ml else None


def side_share(head, chosen):
    x = np.arange(head.shape[2])
    middle = (head.sum(axis=(0, 1)) * x).sum() / head.sum()
    low = int(chosen[:, :, x < middle].sum())
    return min(low, int(chosen.sum()) - low) / chosen.sum()


def by_depth(v, mm, dark, r):
    low = otsu(v.ravel())
    above = v > low
    opened = one(K.largest, one(K.fill_outside, above))
    closed = above
    for _ in range(r.closing_voxels):
        closed = one(K.dilate, closed)
    head = one(K.largest, one(K.fill_outside, closed))
    for _ in range(r.closing_voxels):
        head = one(K.erode, head)
    if not head.any():
        return None
    tissue = otsu(v[opened])
    candidate = head & (v <= low) if dark else head & (v > tissue) if tissue is not None else np.zeros_like(head)
    deep = distance(head, mm)
    parts = [c for c in components(candidate) if c.sum() >= r.least_voxels and deep[c].min() >= r.depth]
    mask = np.zeros_like(head)
    for c in sorted(parts, key=lambda c: -c.sum())[: r.most_components]:
        mask |= c
    if candidate.sum() > head.sum() * r.most_fluid:
        return np.zeros_like(head), "thresholdDidNotIsolateCsf", 0
    if dark and tissue is not None:
        edge = otsu(v[opened & (v <= tissue)])
        if edge is not None:
            steps = [int(r.growth / s + 1e-9) for s in mm]
            for k in range(max(steps)):
                ways = [(axis, by) for axis, n in ((1, steps[0]), (2, steps[1]), (3, steps[2])) if k < n for by in (1, -1)]
                mask = one(K.dilate, mask, head & (v <= max(low, edge)), neighbours=ways)
    why = verdict(mask, head, r, math.prod(mm) / 1000)
    if why is None and side_share(head, mask) < r.least_side:
        why = "oneSided"
    return mask, why, int(mask.sum())


def by_cores(v, mm, r):
    ml, low = math.prod(mm) / 1000, otsu(v.ravel())
    if low is None:
        return None
    above = v > low
    outer = one(K.largest, one(K.fill_outside, above | (distance(~above, mm) <= r.core_closing)))
    head = distance(outer, mm) > r.core_closing
    if not head.any():
        return None
    deep = distance(head, mm)
    candidate = head & ~above & (deep >= r.depth)
    core = candidate & (distance(candidate, mm) >= r.core_thickness)
    chosen = np.zeros_like(head)
    for c in components(core):
        if c.sum() * ml < r.core_ml:
            continue
        z, y, x = (int(a.mean()) for a in np.nonzero(c))
        column = np.flatnonzero(above[:, y, x])
        last = max([z, *column[column >= z]])
        headroom = math.inf if last in (0, v.shape[0] - 1) else (last - z) * mm[0]
        if deep[c].min() >= r.core_depth and v[c].mean() >= low * r.core_brightness and headroom <= r.core_headroom:
            chosen |= c
    if not chosen.any() or side_share(head, chosen) < r.least_side:
        return None
    ventricle = flood(chosen, candidate & (distance(~chosen, mm) <= r.core_growth))
    near = distance(~ventricle, mm)
    shell = np.sort(v[~ventricle & head & (near >= r.shell[0]) & (near <= r.shell[1])])
    fluid = v[chosen].mean()
    boundary = (fluid + shell[len(shell) // 2]) / 2 if len(shell) else fluid
    mask = flood(ventricle, head & (v <= boundary) & (near <= r.core_rim))
    return mask, verdict(mask, head, r, ml)


def segment(v, mm, dark, r):
    """(mask, path, refusal); mm and arrays in the order z, y, x."""
    nothing = np.zeros(v.shape, bool)
    if otsu(v.ravel()) is None or (depth := by_depth(v, mm, dark, r)) is None:
        return nothing, None, "noHead"
    mask, why, n = depth
    if why is None:
        return mask, "depth", None
    if not dark:
        return nothing, None, why
    cores = by_cores(v, mm, r)
    if cores is not None:
        if cores[1] is None:
            return cores[0], "cores", None
        why = cores[1] if n == 0 else why
    sigma = [s if s >= 0.3 else 0.0 for s in (math.sqrt(max(0.0, r.smoothing**2 - m * m)) / 2.3548 / m for m in mm)]
    if any(sigma):
        smoothed = by_cores(K.gaussian(v[None], tuple(sigma))[0], mm, r)
        if smoothed is not None and smoothed[1] is None:
            at = np.nonzero(smoothed[0])
            if min(min(a.min(), n - 1 - a.max()) * s for a, n, s in zip(at, v.shape, mm)) >= r.smoothed_margin:
                return smoothed[0], "smoothedCores", None
    return nothing, None, why
