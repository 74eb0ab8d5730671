"""The sweep of working copies, for batches and streams: a pure expression of each row and the given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.rules import first_match


def outcome(active: Column, has_key: Column, created: Column, now: Column, hours: int, locked: Column) -> Column:
    """kept, orphaned (no key or no stamp), expired (``hours`` or older) or failed (expired, but not to be deleted)."""
    old = created <= now - F.expr(f"INTERVAL {hours} HOURS")
    return first_match([("kept", active), ("orphaned", ~has_key | created.isNull()), ("failed", old & locked), ("expired", old)], "kept")


def sweep_stream(copies: DataFrame, hours: int = 24) -> DataFrame:
    """A stream of (copy, active, has_key, created, locked) with the outcome as of each batch."""
    return copies.withColumn("outcome", outcome(F.col("active"), F.col("has_key"), F.col("created"), F.current_timestamp(), hours, F.col("locked")))
