"""Nested JSON documents as indented text lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _lines(value, name: str, depth: int) -> Iterator[tuple[int, str, bool]]:
    if isinstance(value, dict):
        yield depth, name, True
        for k, v in value.items():
            yield from _lines(v, k, depth + 1)
    elif isinstance(value, list):
        yield depth, name, True
        for i, v in enumerate(value):
            yield from _lines(v, f"[{i}]", depth + 1)
    else:
        yield depth, f"{name}: {'—' if value is None else value}", False


def outlined(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line, depth, text, heading) of every document; an unreadable one gives no line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[column]):
                try:
                    document = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(k, i, *x) for i, x in enumerate(_lines(document, "report", 0))]
            yield pd.DataFrame(rows, columns=[key, "line", "depth", "text", "heading"])

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, line int, depth int, text string, heading boolean")
