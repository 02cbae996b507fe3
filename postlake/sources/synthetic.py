"""Synthetic source records for benchmarks: seeded, repeatable, generated in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPY_SHARE = 0.2


def _pick(salt: int, size: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size)).cast("string")


def _unit(salt: int) -> Column:
    """Uniform number in [0, 1) that depends on the row id only, not on the partitioning."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def source_records(spark: SparkSession, rows: int, copies: float = COPY_SHARE) -> DataFrame:
    """``rows`` records shaped like silver source records; a share are near-copies whose dates
    moved by 0-10 days. Copies are the ids with the smallest hash, an exact count."""
    base = round(rows * (1 - copies))
    first = spark.range(base).select(
        "id",
        F.concat(F.lit("synthetic-"), F.col("id")).alias("source_record_key"),
        F.concat(F.lit("site"), F.col("id") % 2000, F.lit(".id")).alias("source_domain"),
        F.concat(F.lit("org"), _pick(1, max(base // 8, 1))).alias("organization_key"),
        F.concat(F.lit("title"), _pick(2, 400)).alias("title_key"),
        F.concat(F.lit("city"), _pick(3, 500)).alias("place_key"),
        F.concat(F.lit("province"), _pick(4, 38)).alias("province"),
        F.concat(F.lit("family"), _pick(5, 20)).alias("role_family"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.round(_unit(6) * 1000).cast("int")).alias("anchor_date"),
        (2_000_000 + F.round(_unit(7) * 15_000_000)).cast("bigint").alias("salary_monthly_min"),
        (_unit(8) < 0.3).alias("salary_reliable"),
        F.transform(
            F.sequence(F.lit(0), F.round(_unit(9) * 5).cast("int")),
            lambda x: F.concat(F.lit("skill"), F.pmod(F.xxhash64("id", x), F.lit(81))),
        ).alias("skills"),
    ).withColumn("skills", F.slice("skills", F.lit(1), F.size("skills") - 1))
    copied = first.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(rows - base).withColumns(
        {
            "source_record_key": F.concat(F.lit("synthetic-copy-"), F.col("id")),
            "anchor_date": F.date_add("anchor_date", F.round(_unit(10) * 10).cast("int")),
        }
    )
    return first.unionByName(copied).drop("id")
