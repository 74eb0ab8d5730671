"""Members of tar archives (plain or gzip), read as a stream without unpacking to disk."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unpacked(files: DataFrame, suffix: str = "") -> DataFrame:
    """(archive, name, content) of the members of archives (path, content) whose names end in ``suffix``; members are
    read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                with tarfile.open(fileobj=io.BytesIO(raw.as_buffer()), mode="r|*") as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(suffix):
                            yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [member.name], "content": [tar.extractfile(member).read()]})

    return files.select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``unpacked`` of all archives below ``path``."""
    return unpacked(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), suffix)


def packed(entries: DataFrame, a_file: int = 256) -> DataFrame:
    """(path, content): gzip tar archives of the entries (name, content), at most ``a_file`` of them in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, a_file):
                buffer, part = io.BytesIO(), batch.slice(at, a_file)
                with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
                    for name, raw in zip(part.column(0).to_pylist(), part.column(1)):
                        info = tarfile.TarInfo(name)
                        info.size = len(raw.as_buffer())
                        tar.addfile(info, io.BytesIO(raw.as_buffer()))
                yield pa.RecordBatch.from_pydict({"path": [part.column(0)[0].as_py() + ".tar.gz"], "content": [buffer.getvalue()]})

    return entries.select("name", "content").mapInArrow(run, "path string, content binary")


def name_parts(name: Column, sep: str = "-") -> Column:
    """The site in an entry's name, the second of at least four parts; ``?`` for other names."""
    parts = F.split(name, sep)
    return F.when(F.size(parts) >= 4, parts[1]).otherwise("?")
