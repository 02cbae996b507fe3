"""Reading tables and cutting lineage for the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postlake.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows that a Python worker gets at once while a table is written, so long texts and sets don't pile up.
ROWS_AT_ONCE = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, what: str, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps neither repeat it nor lose it with an executor."""
    spark = df.sparkSession
    path, before = shared_path(spark, what), spark.conf.get(_ROWS_SETTING)
    spark.conf.set(_ROWS_SETTING, rows_at_once)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)
