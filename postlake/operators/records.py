"""Observations to source records: re-observations, first captures, column-wise collapse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last_struct(*columns: str) -> Column:
    """An ordering struct in which NULL fields count as greatest."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row per key. An aggregate, not a window, so hot keys are combined map-side;
    the rest of the row breaks ties."""
    rest = [c for c in df.columns if c not in keys]
    comparable = [c for c in rest if not df.schema[c].dataType.typeName().startswith(("map", "variant"))]
    order_by = F.struct(F.struct(*order), F.struct(*comparable))
    best = F.min_by(F.struct(*rest), order_by).alias("m")
    return df.groupBy(*keys).agg(best).select(*keys, "m.*").select(*df.columns)


def latest_values(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column, mode: str = "column",
    latest: bool = True,
) -> list[Column]:
    """Aggregate expressions for a representative row per key.

    ``mode='column'`` takes each column's latest non-NULL value, so a record may combine rows;
    ``mode='row'`` takes the latest row whole.
    """
    pick = F.max_by if latest else F.min_by
    if mode == "row":
        return [pick(F.col(v), order).alias(v) for v in values]
    return [pick(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in values]


PROVENANCE = (
    "observation_type", "crawl", "captured_at", "bronze_file", "warc_filename",
    "warc_record_offset", "content_digest",
)


def source_records(
    observations: DataFrame, key: str = "source_record_key", captured: str = "captured_at",
    digest: str = "content_digest", file: str = "bronze_file", crawl: str = "crawl",
    provenance: Sequence[str] = PROVENANCE, mode: str = "column",
) -> DataFrame:
    """One row per key: latest value of each column, first/last seen, observation and crawl counts."""
    dropped = {key, *provenance}
    values = [c for c in observations.columns if c not in dropped]
    order = nulls_last_struct(captured, digest, file)
    return observations.groupBy(key).agg(
        *latest_values(observations, [key], values, order, mode),
        F.min(captured).alias("first_seen_at"),
        F.max(captured).alias("last_seen_at"),
        F.count("*").alias("observations"),
        F.count_distinct(crawl).alias("crawls_observed"),
        F.array_sort(F.collect_set(crawl)).alias("crawls"),
    )


def with_reobservations(captures: DataFrame, reobservations: DataFrame) -> DataFrame:
    """Captures plus, for every unchanged re-capture, the postings of the earliest capture of
    the same page and digest, seen again at the re-capture's time."""
    first = first_per_key(
        captures, ["page_url", "content_digest", "posting_position"], ["captured_at", "bronze_file"]
    )
    again = reobservations.select("crawl", "url", "content_digest", "index_fetch_time").distinct().select(
        F.col("crawl").alias("r_crawl"), F.col("url").alias("page_url"), "content_digest",
        F.col("index_fetch_time").alias("r_time"),
    )
    seen = first.join(again, ["page_url", "content_digest"]).withColumns(
        {
            "observation_type": F.lit("reobservation"),
            "crawl": F.col("r_crawl"),
            "captured_at": F.col("r_time"),
            "bronze_file": F.lit(None).cast("string"),
        }
    )
    return captures.unionByName(seen.select(*captures.columns))
