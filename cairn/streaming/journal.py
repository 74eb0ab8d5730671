"""A journal that any number of writers append to: every batch goes on from the head that its writer has read, and is
published only if that still is the head (see ``operators.publish``). The manifest keeps the head, its hash and number, so
no append reads the journal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import publish
from cairn.operators.journal import GENESIS, SEPARATOR

SCHEMA = "n long, payload string, prev string, hash string"


def appender(path: str, order: str, payload: str, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends (n, payload, prev, hash) to the journal below ``path``. A journal is one chain
    of audit events by nature: one task takes a batch in order and streams through it. A batch that ``writer`` has appended
    is skipped when it comes again; writers of other names append independently. The rows do not pass the driver."""

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col(order).alias("at"), F.col(payload).alias("payload"))

        def go_on(head: publish.Manifest):
            done = head.meta.get("batches", {})
            if batch_id <= done.get(writer, -1):
                return None
            last, number = head.meta.get("hash", GENESIS), head.meta.get("n", 0)

            def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                prev, n = last, number
                for part in parts:
                    out = []
                    for text in part["payload"]:
                        n, digest = n + 1, sha256(f"{prev}{SEPARATOR}{text}".encode()).hexdigest()
                        out.append((n, text, prev, digest))
                        prev = digest
                    yield pd.DataFrame(out, columns=["n", "payload", "prev", "hash"])

            def meta(staged: DataFrame) -> dict:
                end = staged.agg(F.max("n"), F.max_by("hash", "n")).first()
                return {"n": end[0] or number, "hash": end[1] or last, "batches": done | {writer: batch_id}}

            return rows.repartition(1).sortWithinPartitions("at").mapInPandas(chain, SCHEMA), False, meta

        publish.update(batch.sparkSession, path, go_on)

    return append


def read(spark: SparkSession, path: str) -> DataFrame:
    """(n, payload, prev, hash) of all published batches."""
    return publish.read(spark, path)
