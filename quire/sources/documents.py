"""Scans of document files, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read(spark: SparkSession, path: str, *, pattern: str | None = None, recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """``path, modificationTime, length, content``; a bound on length is pushed to the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    files = reader.load(path)
    return files.filter(files.length <= max_bytes) if max_bytes is not None else files


def stream(spark: SparkSession, path: str, *, pattern: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The same rows for files as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
