"""Durable intermediates in the folder that the cluster shares.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``, so a lost executor costs a re-read and not a
recomputation. Where the session names no such folder, one machine gets a temporary one; a cluster is refused, since
its executors could not see each other's files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


#: Spark removes a query's shuffle files when it has ended: its result is a table by then.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose tables go when it ends: what leaves it must be stored with ``durable(..., keep=True)``, and then
    belongs to the scope around it, if there is one."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes ``df`` once as compressed Parquet in the shared folder and returns a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark)
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
