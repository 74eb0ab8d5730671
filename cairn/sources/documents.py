"""JSON, journal and delimited text sources with fixed schemas; what can't be read is counted, never dropped unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES_SCHEMA = (
    "series_id string, study_id string, subject_id string, tier string, weighting string, contrast_enhanced boolean, slice_count int, voxel_spacing_mm array<double>"
)
EVENT_SCHEMA = "event string, previousHash string, hash string"


def manifest(spark: SparkSession, path: str, version: str = "1.0.0") -> DataFrame:
    """The flat series of manifests; another schema version, or an unreadable file, stops the query."""
    fields = ", ".join(f"{n}: {k}" for n, k in (x.split(" ", 1) for x in SERIES_SCHEMA.split(", ")))
    read = spark.read.schema(f"schema_version string, series array<struct<{fields}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = read.where(F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.lit("unsupported schema_version")).cast("boolean")))
    return checked.select(F.inline("series"))


def reports(spark: SparkSession, path: str, schema: str, a_file: bool = True) -> DataFrame:
    """Reports with their study (the folder's name) and whether they could be read; with ``a_file`` a file is one
    report, else every line is."""
    texts = spark.read.option("wholetext", a_file).option("recursiveFileLookup", True).text(path)
    return _read_reports(texts.select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("study")), schema)


def packed_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same of files that each hold the reports of many folders: lines of a report's path, a tab and its text."""
    parts = F.split("value", "\t", 2)
    return _read_reports(spark.read.text(path).select(F.get(parts, F.lit(1)).alias("value"), F.element_at(F.split(parts[0], "/"), -2).alias("study")), schema)


def _read_reports(texts: DataFrame, schema: str) -> DataFrame:
    found = texts.withColumn("r", F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    names = [f.name for f in found.schema["r"].dataType if f.name != "_corrupt_record"]
    return found.select(*[F.col("r")[n].alias(n) for n in names], "study", (F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).alias("readable"))


RESULT_SCHEMA = "key long, n long, analysedSeries struct<Weighting string>, biomarkers array<struct<Method string, Value double>>"


def results(spark: SparkSession, path: str, weighting: str, method: str) -> DataFrame:
    """(key, value) of batch results kept as JSON lines: series of one weighting, one biomarker, a key's last line."""
    kept = spark.read.schema(RESULT_SCHEMA).json(path).where(F.col("analysedSeries.Weighting") == weighting).select("key", "n", F.explode("biomarkers").alias("b"))
    return kept.where(F.col("b.Method") == method).groupBy("key").agg(F.max_by("b.Value", "n").alias("value"))


def semicolons(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated text with quotes doubled inside quotes; a byte order mark before the first header name goes."""
    read = spark.read.option("sep", ";").option("quote", '"').option("escape", '"').option("header", True).csv(path)
    return read.toDF(*[n.lstrip("﻿") for n in read.columns])


def journal(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """Journal lines (order, event, previousHash, hash, state): blank ones are skipped; an unreadable last line is an
    incomplete tail and no break, any other one is unreadable."""
    kept = lines.withColumn("__l", F.rtrim(F.replace(F.col(line), F.lit("\r"), F.lit("")))).where("__l <> ''")
    parsed = kept.withColumn("r", F.from_json("__l", EVENT_SCHEMA + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    last = kept.agg(F.max(order).alias("__last"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.col("r.hash").isNull()
    state = F.when(~bad, "record").when(F.col(order) == F.col("__last"), "incompleteTail").otherwise("unreadable")
    return parsed.crossJoin(F.broadcast(last)).select(order, "r.event", "r.previousHash", "r.hash", state.alias("state"))  # one row


def checksum_line(line: Column) -> tuple[Column, Column]:
    """(hash, name) of ``hash  name``; both null unless the hash has 64 digits."""
    parts = F.split(line, "  ", 2)
    good = (F.size(parts) == 2) & F.rlike(parts[0], F.lit("^[0-9a-f]{64}$"))
    return F.when(good, parts[0]), F.when(good, F.get(parts, F.lit(1)))
