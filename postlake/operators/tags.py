"""Statistics of tags shown on listing cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators.breakdown import top_with_remainder
from postlake.operators.filters import JobFilters, apply_filters
from postlake.rules import limits


def _tagging(jobs: DataFrame) -> DataFrame:
    """Sources that show tags at all; only they form the denominator."""
    shows = (F.size("source_tags") > 0) | (F.col("hidden_tag_count") > 0)
    return jobs.filter(shows).select("primary_source_id").distinct()


def _tagged(jobs: DataFrame, filters, as_of, window_days) -> DataFrame:
    return apply_filters(jobs, filters, as_of, window_days).join(_tagging(jobs), "primary_source_id", "left_semi")


def tag_summary(jobs, filters: JobFilters | None = None, as_of=None, window_days=limits.LIFECYCLE_DAYS) -> DataFrame:
    n = F.size("source_tags")
    return _tagged(jobs, filters, as_of, window_days).agg(
        F.count("*").alias("total_jobs"),
        F.count_if(n > 0).alias("jobs_with_visible_tags"),
        F.count_if(F.col("hidden_tag_count") > 0).alias("jobs_with_hidden_tags"),
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("visible_tags"),
        F.coalesce(F.sum("hidden_tag_count"), F.lit(0)).cast("bigint").alias("hidden_tags"),
    )


def top_tags(jobs, filters: JobFilters | None = None, limit: int = 20, as_of=None,
             window_days=limits.LIFECYCLE_DAYS) -> DataFrame:
    """The commonest tags, with the number of tags and how often those beyond the limit occur."""
    counts = _tagged(jobs, filters, as_of, window_days).select(F.explode("source_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
    return top_with_remainder(counts, "count", [F.desc("count"), F.col("tag")], limit).drop("total")


def tag_role_families(jobs, filters: JobFilters | None = None, as_of=None, window_days=limits.LIFECYCLE_DAYS) -> DataFrame:
    """Jobs per role family, ignoring any role-family filter."""
    open_filters = filters.without("role_family") if filters else None
    return (
        _tagged(jobs, open_filters, as_of, window_days).groupBy("role_family")
        .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "role_family")
    )
