"""File intake, order-free merges, unchanged re-captures and openings as streams.

All state lives in the checkpoint folder the caller names; on a cluster that is a shared
folder, so a restarted query continues where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlake import schemas
from postlake.rules import limits
from postlake.plans.silver import observations_and_rejects
from postlake.sources.intake import VERSION
from postlake.sources.lake import capture_origin


def version_folder(root: str, version: str = VERSION) -> str:
    """Checkpoint folder of a parser version: a new version starts over and reads everything."""
    return f"{root}/{version.replace('/', '_')}"


def capture_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.CAPTURE).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(path)
        .select("*", *capture_origin())
    )


def run_available(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process what has arrived since the last run, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_observations(target: str):
    """Batch writer: observations and failed captures of a batch in one pass over it, in folders by kind.

    A batch writes to its own folder and overwrites it, so a retried batch is not doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        observations_and_rejects(batch).write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(f"{target}/batch={batch_id}")

    return write


def read_observations(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).filter("kind = 'observation'").select(*schemas.OBSERVATION_COLUMNS)


def read_rejects(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).filter("kind = 'reject'").select("registry_source_id", "bronze_file", "page_url", "captured_at", "fetch_result")


def append_parsed(parse: Callable[[DataFrame], DataFrame], target: str, rejects: str | None = None):
    """Batch writer: parsed rows of each batch appended; failed captures to ``rejects``.

    A batch writes to its own folder and overwrites it, so a retried batch is not doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parse(batch.filter(F.col("fetch_result") == "ok")).write.mode("overwrite").option(
            "compression", "zstd"
        ).parquet(f"{target}/batch={batch_id}")
        if rejects:
            batch.filter(F.col("fetch_result") != "ok").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return write


def widen_seen(keys: Sequence[str], target: str):
    """Batch writer keeping (keys, first_seen_at, last_seen_at, sightings) as partial aggregates.

    Each batch writes its own min/max/count rows; ``read_seen`` merges them. The merge does
    not depend on order, so late data never moves a time back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(
            F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"),
            F.count("*").alias("sightings"),
        ).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def read_seen(spark: SparkSession, keys: Sequence[str], target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy(*keys).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.sum("sightings").alias("sightings"),
    )


def new_contents(stream: DataFrame, keys: Sequence[str] = ("url", "content_digest")) -> DataFrame:
    """Each page content once, however late or far apart its captures are; unchanged re-captures
    are dropped here and counted by the sightings path.

    There is no watermark: all keys met so far stay in the state under the checkpoint folder. For
    more keys than executors' memory holds, set ``spark.sql.streaming.stateStore.providerClass`` to
    Spark's RocksDB provider, which keeps them on disk.
    """
    return stream.dropDuplicates(list(keys))


def opening_sessions(df: DataFrame, keys: Sequence[str], time: str, gap_days: int = limits.SAME_OPENING_DAYS,
                     delay: str | None = None) -> DataFrame:
    """Openings as session windows (batch or stream): on midnight timestamps a gap of exactly
    ``gap_days`` still merges, as in the batch rule."""
    if delay:
        df = df.withWatermark(time, delay)
    window = F.session_window(time, f"{gap_days} days")
    return df.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("rows")).select(
        *keys, F.col("w.start").alias("first_at"), "rows"
    )
