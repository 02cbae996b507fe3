"""First and last sighting per key as one small state each, whatever the order of arrival.

The state of a key is three values in the state store (RocksDB, on the executors' disks, with its
changes in the checkpoint folder), so a batch costs what its keys cost, not what all keys cost. Minimum,
maximum and count don't depend on order: late and shuffled batches give the same table. It is a streaming
aggregate: a batch is reduced to its keys before the shuffle, and no row leaves the JVM. A key's rows are
dealt to ``SLICES`` states by their own hash and merged on reading. Checkpoints of the former processor
hold another kind of state: a stream that moves to this one starts a new checkpoint folder and target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICES = 16


def sightings(stream: DataFrame, keys: Sequence[str], time: str = "seen_at") -> DataFrame:
    """(keys, slice, first_seen_at, last_seen_at, sightings) of the keys that a batch saw, as a stream in update mode."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = stream.select(*keys, F.pmod(F.xxhash64(*stream.columns), F.lit(SLICES)).cast("int").alias("slice"), F.col(time).cast("timestamp").alias("seen_at"))
    return rows.groupBy(*keys, "slice").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("sightings"))


def keep_sightings(stream: DataFrame, keys: Sequence[str], target: str, checkpoint: str, time: str = "seen_at") -> None:
    """Take in what has arrived; each batch writes its keys' new states to its own folder, so a repeated batch is not doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = sightings(stream, keys, time).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_sightings(spark: SparkSession, keys: Sequence[str], target: str) -> DataFrame:
    """(keys, first_seen_at, last_seen_at, sightings): the newest state of each slice, merged."""
    newest = spark.read.parquet(target).groupBy(*keys, "slice").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("sightings").alias("sightings"))
    return newest.groupBy(*keys).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("sightings").alias("sightings"))
