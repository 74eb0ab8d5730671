"""Pseudonyms, split buckets and content keys as Column expressions over SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(*parts: Column) -> Column:
    """Parts with their lengths in front, so that different parts never read the same: ``len:part|``."""
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p, F.lit("|")) for p in parts])


def pseudonym(salt: str, scope: Column | str, value: Column) -> Column:
    """32 hex digits of the framed salt, scope and value."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return F.substring(sha256_hex(framed(F.lit(salt), scope, value)), 1, 32)


def split_bucket(seed: int, subject: Column) -> Column:
    """A number in [0, 1): the first 64 bits of the hash of ``seed:subject`` over 2^64."""
    head = F.substring(sha256_hex(F.concat(F.lit(f"{seed}:"), subject)), 1, 16)
    return F.conv(head, 16, 10).cast("double") / F.lit(2.0**64)


def split_name(bucket: Column, train: float, validation: float) -> Column:
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def day_shift(hash_hex: Column) -> Column:
    """A negative number of days, 1 to 3650 back, from the first 32 bits of a hash."""
    return -(F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("long") % 3650 + 1)


def fingerprint(ids: Column) -> Column:
    """16 upper-case hex digits of an array of ids in order."""
    return F.upper(F.substring(sha256_hex(F.array_join(F.array_sort(ids), "|")), 1, 16))
