"""Salary overview, dense histogram and comparison over comparable salaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.breakdown import DIMENSIONS, label_of, top_with_remainder
from postlake.operators.filters import JobFilters, apply_filters
from postlake.operators.pay_rule import comparable_salary, monthly_idr_recorded, monthly_midpoint
from postlake.operators.percentiles import grouped_percentiles, join_groups
from postlake.rules import limits

FLAGS = ("SALARY_WIDE_RANGE", "SALARY_HIGH_OUTLIER", "SALARY_LOW_OUTLIER")


def enough(n: Column, value: Column, minimum: int = limits.MIN_SALARY_SAMPLE) -> Column:
    return F.when(n >= minimum, value)


def salary_overview(
    jobs: DataFrame, filters: JobFilters | None = None, as_of=None,
    window_days: int = limits.LIFECYCLE_DAYS, minimum: int = limits.MIN_SALARY_SAMPLE,
) -> DataFrame:
    """One row: totals, eligibility, p10..p90 of midpoints, medians of the bounds, flag counts."""
    jobs = apply_filters(jobs, filters, as_of, window_days)
    ok = comparable_salary()
    counts = jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(ok).alias("eligible"),
        F.count_if(monthly_idr_recorded() & ~ok).alias("excluded_implausible"),
        F.count_if(ok & F.col("salary_period_assumed")).alias("period_assumed"),
        *[F.count_if(ok & F.array_contains("quality_flags", f)).alias(f.lower()) for f in FLAGS],
    )
    eligible = jobs.filter(ok)
    # The three measures are ranked in one pass by unpivoting them into (measure, value).
    long = eligible.select(
        F.explode(
            F.array(
                F.struct(F.lit("midpoint").alias("measure"), monthly_midpoint().alias("x")),
                F.struct(F.lit("low").alias("measure"), F.col("salary_monthly_min").cast("double").alias("x")),
                F.struct(F.lit("high").alias("measure"), F.col("salary_monthly_max").cast("double").alias("x")),
            )
        ).alias("m")
    ).select("m.*")
    q = grouped_percentiles(long, ["measure"], "x", limits.PERCENTILES)
    names = [f"p{round(p * 100)}" for p in limits.PERCENTILES]
    flat = q.agg(
        *[F.max(F.when(F.col("measure") == "midpoint", F.col(n))).alias(n) for n in names],
        F.max(F.when(F.col("measure") == "low", F.col("p50"))).alias("median_min"),
        F.max(F.when(F.col("measure") == "high", F.col("p50"))).alias("median_max"),
    )
    both = counts.withColumn("q", flat.select(F.struct("*")).scalar())
    return both.select(
        *counts.columns,
        *[enough(F.col("eligible"), F.col(f"q.{n}"), minimum).alias(n) for n in (*names, "median_min", "median_max")],
    )


def status_counts(jobs: DataFrame, filters: JobFilters | None = None, as_of=None) -> DataFrame:
    jobs = apply_filters(jobs, filters, as_of)
    return jobs.groupBy("salary_status").agg(F.count("*").alias("count"))


def dense_histogram(
    jobs: DataFrame, filters: JobFilters | None = None, as_of=None,
    width: int = limits.APP_BIN_WIDTH, edge: int = limits.APP_UPPER_EDGE,
) -> DataFrame:
    """Every bin, empty ones included; the last is open (upper is NULL)."""
    last = edge // width
    jobs = apply_filters(jobs, filters, as_of).filter(comparable_salary())
    binned = jobs.groupBy(F.least(F.floor(monthly_midpoint() / width), F.lit(last)).alias("bin")).agg(
        F.count("*").alias("count")
    )
    bins = jobs.sparkSession.range(last + 1).withColumnRenamed("id", "bin")
    return bins.join(binned, "bin", "left").select(
        (F.col("bin") * width).alias("lower"),
        F.when(F.col("bin") < last, (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def grouped_salary(
    df: DataFrame, key: str, ok: Column, minimum: int = limits.MIN_SALARY_SAMPLE,
    small: int = limits.SMALL_SALARY_SAMPLE, total: str = "jobs_in_group",
) -> DataFrame:
    """key, n, total, p25, median, p75 (NULL below ``minimum``), small_sample."""
    counts = df.groupBy(key).agg(F.count("*").alias(total), F.count_if(ok).alias("n"))
    q = grouped_percentiles(df.filter(ok), [key], monthly_midpoint(), (0.25, 0.5, 0.75), ("p25", "median", "p75"))
    out = join_groups(counts, q, [key])
    return out.select(
        F.col(key).alias("key"), "n", total,
        *[enough(F.col("n"), F.col(c), minimum).alias(c) for c in ("p25", "median", "p75")],
        (F.col("n") < small).alias("small_sample"),
    )


def salary_compare(
    jobs: DataFrame, by: str = "role_family", filters: JobFilters | None = None, limit: int = 20,
    as_of=None, window_days: int = limits.LIFECYCLE_DAYS,
) -> DataFrame:
    """Quartiles of midpoints per category, the best covered ones first, with the number of categories
    and the comparable salaries in those beyond the limit."""
    if by in ("title", "company"):
        raise ValueError("salary comparison by title or company is not supported: samples are too small")
    column, labels = DIMENSIONS[by]
    out = grouped_salary(apply_filters(jobs, filters, as_of, window_days), column, comparable_salary())
    top = top_with_remainder(out, "n", [F.desc("n"), F.asc_nulls_last("key")], limit).drop("total")
    return top.withColumn("label", label_of(F.col("key"), labels))
