"""Stored files as rows: listed by Spark, opened in tasks."""

from __future__ import annotations

import re
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TASKS = 20_000


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files below path whose name fits; no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def spread(rows: DataFrame) -> DataFrame:
    """A task per row: small rows that stand for much work."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)))


def open_file(path: str) -> BinaryIO:
    """A file for reading with seeks: local, or on a file system that Arrow reaches."""
    if path.startswith(("file:", "/")):
        return open(re.sub("^file:/+", "/", path), "rb")
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(path)
    return system.open_input_file(name)
