"""Listings of files: walk limits and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.histograms import positions
from cairn.operators.rules import first_match

#: The deepest folder, the number of files and the bytes of one file that a walk takes.
MAX_DEPTH, MAX_FILES, MAX_BYTES = 12, 200_000, 512 << 20


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files below the folder ``path``, their paths from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", path.rstrip("/") + "/", -1).alias("path"), F.col("length").alias("size"))


def walk(files: DataFrame, max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, outcome) of a walk over the folders of files (path, size), one level of folders after the other.

    Within a level folders come in the order of their names, from the root on, and a folder's files in the order of
    theirs. The files seen are counted, large ones too: the one after the last allowed is ``tooMany`` and ends the
    walk, so nothing behind it is in the result. A folder below ``max_depth`` is one row, ``tooDeep``, whatever it holds. A
    file of more than ``max_bytes`` is ``tooLarge``, all others are ``read``. The root has depth 0; slashes may be either.

    The levels' numbers of files, of bounded number, tell the level in which the budget ends; only that one is numbered.
    """
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    found = files.select("path", "size", F.slice(parts, 1, F.size(parts) - 1).alias("folder"), F.element_at(parts, -1).alias("name")).withColumn("depth", F.size("folder"))
    allowed = found.where(F.col("depth") <= max_depth)
    seen, ends = 0, None
    for level, n in sorted(map(tuple, allowed.groupBy("depth").agg(F.count(F.lit(1))).collect())):
        if seen + n > max_files:
            ends = level
            break
        seen += n
    outcome = first_match([("tooLarge", F.col("size") > max_bytes)], "read").alias("outcome")
    if ends is None:
        deep = found.where(F.col("depth") > max_depth).select(F.array_join(F.slice("folder", 1, max_depth + 1), "/").alias("path"), F.lit("tooDeep").alias("outcome")).distinct()
        return allowed.select("path", outcome).unionByName(deep)
    last = positions(found.where(F.col("depth") == ends), ["folder", "name", "path"], "n_in_level").where(F.col("n_in_level") <= max_files - seen + 1)
    cut = last.select("path", F.when(F.col("n_in_level") > max_files - seen, "tooMany").otherwise(outcome).alias("outcome"))
    return allowed.where(F.col("depth") < ends).select("path", outcome).unionByName(cut)


def hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, content), slashes forward, in the order of paths."""
    return files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.sha2("content", 256).alias("sha256")).orderBy("path")
