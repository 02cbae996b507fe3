"""The lake's files: bronze readers, Parquet/JSON/CSV writers, published versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schemas
from postlake.rules.sites import ARCHIVE_SOURCE


def read_flat(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """All Parquet files below ``root``; directory names are not turned into columns."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(root)


def capture_origin() -> list[Column]:
    """``bronze_file`` and ``registry_source_id`` of rows as their files are read, in batches and streams."""
    imported = F.regexp_extract("_metadata.file_path", r"/imports/([^/]+)/", 1)
    return [
        F.col("_metadata.file_name").alias("bronze_file"),
        F.when(imported == "", ARCHIVE_SOURCE).otherwise(imported).alias("registry_source_id"),
    ]


def read_captures(spark: SparkSession, *roots: str) -> DataFrame:
    """Bronze captures with ``bronze_file`` and ``registry_source_id`` taken from the path:
    files below ``imports/<source>/`` belong to that source, the others to the web archive."""
    reader = spark.read.schema(schemas.CAPTURE).option("recursiveFileLookup", True)
    return reader.parquet(*roots).select("*", *capture_origin())


def read_reobservations(spark: SparkSession, root: str) -> DataFrame:
    return read_flat(spark, root, schemas.REOBSERVATION)


def write_parquet(df: DataFrame, path: str, partition_by=None, sort_by=None, mode: str = "overwrite") -> None:
    """zstd Parquet; the commit protocol publishes the files atomically per job."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """Candidates clustered by domain and sorted, so later key scans skip row groups."""
    write_parquet(df.repartitionByRange("domain", "url"), path, sort_by=["domain", "url"])


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_run_log(run: DataFrame, path: str) -> None:
    """One run row appended as a JSON line."""
    run.coalesce(1).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays are written as their JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in df.schema
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
