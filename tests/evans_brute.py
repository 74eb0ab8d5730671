"""The Evans index of one dense volume [slice, line, across], voxel by voxel; what the long form is held against."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from .head_brute import otsu

SIDES = [(0, 1), (0, -1), (1, 0), (-1, 0)]
AROUND = SIDES + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def region(plane, seed, neighbours):
    seen, todo = {seed}, deque([seed])
    while todo:
        y, x = todo.popleft()
        for dy, dx in neighbours:
            at = (y + dy, x + dx)
            if at not in seen and 0 <= at[0] < plane.shape[0] and 0 <= at[1] < plane.shape[1] and plane[at]:
                seen.add(at)
                todo.append(at)
    return seen


def find_horns(v, t, mask, mm, window, front_low, r):
    lines = np.flatnonzero(mask.any(axis=(0, 2)))
    if not len(lines):
        return None
    span, front = lines[-1] - lines[0], lines[0] if front_low else lines[-1]
    best = None
    for z in range(len(v)):
        middles = [(np.flatnonzero(row)[0] + np.flatnonzero(row)[-1]) / 2 for row in v[z] > t if row.any()]
        if not middles:
            continue
        middle = sum(middles) / len(middles)
        central, left = np.zeros(mask[z].shape, bool), {tuple(p) for p in np.argwhere(mask[z]).tolist()}
        while left:
            one = region(mask[z], next(iter(left)), AROUND)
            left -= one
            if any(abs(x - middle) <= r.midline_reach / mm[0] for _, x in one):
                for p in one:
                    central[p] = True
        for step in range(int(span * window[0]), int(span * window[1]) + 1):
            y = front + step if front_low else front - step
            xs = np.flatnonzero(central[y])
            side = r.least_side / mm[0]
            if len(xs) and xs[0] <= middle - side and xs[-1] >= middle + side and (best is None or xs[-1] - xs[0] > best[3] - best[2]):
                best = (z, int(y), int(xs[0]), int(xs[-1]))
    return best


def find_skull(v, t, horns, mm, r, mask=None):
    z, line, first, last = horns
    bright = v[z] > t
    tissue = bright if mask is None else bright | mask[z]
    steps = max(1, round(r.separation / mm[0]))
    core = tissue
    ny, nx = tissue.shape
    inner = [(y, x) for y in range(1, ny - 1) for x in range(1, nx - 1)]
    for _ in range(steps):
        less = np.zeros_like(core)
        for y, x in inner:
            less[y, x] = core[y, x] and all(core[y + a, x + b] for a, b in SIDES)
        core = less
    places = [tuple(p) for p in np.argwhere(core).tolist()]
    if not places:
        return None
    centre = (first + last) // 2
    seed = min(places, key=lambda p: (abs(p[1] - centre) + abs(p[0] - line), p))
    brain = np.zeros_like(core)
    for p in region(core, seed, SIDES):
        brain[p] = True
    for _ in range(steps):
        more = brain.copy()
        for y, x in inner:
            more[y, x] |= tissue[y, x] and any(brain[y + a, x + b] for a, b in SIDES)
        brain = more
    best = None
    for y in range(ny):
        xs = np.flatnonzero(brain[y])
        if not len(xs):
            continue
        bands = []
        for edge, way in ((xs[0], -1), (xs[-1], 1)):
            for band in range(math.ceil(r.widest_band / mm[0])):
                x = edge + way * (band + 1)
                if not 0 <= x < nx:
                    break
                if bright[y, x]:
                    bands.append((way, band))
                    break
        bands = dict(bands)
        if len(bands) == 2:
            inside = xs[-1] - xs[0] + 1 + (bands[-1] + bands[1]) / 2
            if best is None or inside > best[0]:
                best = (inside, y, xs[0] - bands[-1] / 2, xs[-1] + bands[1] / 2)
    return best and tuple(best[1:])


def lengthened(horns, stop, most=math.inf):
    z, y, first, last = horns
    a, b = first, last
    while a > 0 and not stop[z, y, a - 1] and first - a < most:
        a -= 1
    while b < stop.shape[2] - 1 and not stop[z, y, b + 1] and b - last < most:
        b += 1
    return z, y, a, b


def answer(refusal, horns=None, skull=None, width=None):
    if refusal or not horns or not skull:
        return (refusal or ("innerSkullNotFound" if horns else "frontalHornsNotFound"),) + (None,) * 8
    return (None, (horns[3] - horns[2] + 1 if width is None else width) / (skull[2] - skull[1] + 1), *horns, *map(float, skull))


def measure(v, mask, mm, r, front_low=True, grow=0):
    t = otsu(v.ravel())
    horns = None if t is None else find_horns(v, t, mask, mm, r.frontal, front_low, r)
    skull = horns and find_skull(v, t, horns, mm, r, mask)
    if horns and grow:
        horns = lengthened(horns, v > t, max(1, round(grow / mm[0])))
    return answer(None, horns, skull)


def seeded(v, a, b, mm, r):
    """a and b are (x, y, z)."""
    z = round(a[2])
    if z != round(b[2]) or not 0 <= z < len(v):
        return answer("markedPointsOnDifferentPlanes")
    t = otsu(v.ravel())
    line = min(max(round((a[1] + b[1]) / 2), 0), v.shape[1] - 1)
    horns = (z, line, round(min(a[0], b[0])), round(max(a[0], b[0])))
    return answer(None, horns, None if t is None else find_skull(v, t, horns, mm, r), math.sqrt(sum(((p - q) * m) ** 2 for p, q, m in zip(a, b, mm))) / mm[0])


def chamfer(on, mm):
    """To the nearest pixel of ``on``, by relaxation until nothing changes."""
    d = np.where(on, 0.0, np.inf)
    while True:
        new = d.copy()
        for dy, dx in AROUND:
            cost = math.hypot(dy * mm[1], dx * mm[0])
            for y in range(d.shape[0]):
                for x in range(d.shape[1]):
                    if 0 <= y + dy < d.shape[0] and 0 <= x + dx < d.shape[1]:
                        new[y, x] = min(new[y, x], new[y + dy, x + dx] + cost)
        if (new == d).all():
            return d
        d = new


def on_slices(v, mm, r, front_low=True):
    t = otsu(v.ravel())
    if t is None or not (v > t).any():
        return answer("segmentationRefused")
    raw = np.zeros(v.shape, bool)
    for z, y in np.ndindex(*v.shape[:2]):
        xs = np.flatnonzero(v[z, y] > t)
        if len(xs):
            part = v[z, y, xs[0] : xs[-1] + 1]
            raw[z, y, xs[0] : xs[-1] + 1] = (part < t) & (part > t * r.fluid_floor)
    opened = np.zeros(v.shape, bool)
    for z in range(len(v)):
        core = raw[z] & (chamfer(~raw[z], mm) >= r.opening - 1e-9)
        opened[z] = raw[z] & (chamfer(core, mm) <= r.opening + 1e-9)
    horns = find_horns(v, t, opened, mm, r.frontal_of_slices, front_low, r)
    skull = horns and find_skull(v, t, horns, mm, r)
    return answer(None, horns and lengthened(horns, ~raw), skull)
