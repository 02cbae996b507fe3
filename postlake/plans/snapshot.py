"""Reports of the original snapshot profile: leading values, mean pay, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.snapshot import NOT_SPECIFIED


def leading(df: DataFrame, column: str, limit: int | None = 10, name: str = "count", skip_missing: bool = True) -> DataFrame:
    """The most frequent values; ties by value."""
    rows = df.filter(F.col(column).isNotNull() & (F.col(column) != NOT_SPECIFIED)) if skip_missing else df
    counts = rows.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)
    return counts.limit(limit) if limit else counts


def mean_pay(df: DataFrame) -> DataFrame:
    shown = df.filter("salary_visible = 1 and salary_min > 0 and salary_max > 0")
    return shown.agg(F.avg("salary_min").alias("mean_min"), F.avg("salary_max").alias("mean_max"))


def equal_bins(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, count) over the observed range; the last bin is closed.

    Bounds are one-row scalars; every bin is listed, empty ones too.
    """
    x = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    rows = df.filter(F.col(column).isNotNull()).select(x.alias("x")).withColumn("e", ends)
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("e.lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("e", ends)
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("e.lo") + F.col("bin") * width).alias("lower"),
        (F.col("e.lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
