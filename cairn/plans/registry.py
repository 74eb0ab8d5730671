"""All registered queries with their SQL oracles, one catalogue module per survey section."""

from __future__ import annotations

from . import aggregates, filters, joins, pipelines, projections, scans, voxels, windows

CATALOGUES = (scans.cat, projections.cat, filters.cat, joins.cat, aggregates.cat, windows.cat, voxels.cat, pipelines.cat)


def queries() -> dict:
    return {name: q for c in CATALOGUES for name, q in c.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for c in CATALOGUES for name, sql in c.ORACLES.items()}
