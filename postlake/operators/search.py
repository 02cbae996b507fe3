"""Job search: sort orders, stable pages, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.similarity import word_similarity
from postlake.operators.filters import JobFilters, apply_filters
from postlake.operators.pay_rule import comparable_salary
from postlake.rules import limits

SORTS = ("newest", "salary_desc", "title", "company", "relevance")


def sort_keys(sort: str, as_of, filters: JobFilters | None = None) -> list[Column]:
    """Order columns of a sort; ``id`` always comes last so pages are stable."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    if sort == "relevance" and filters is not None and filters.query:
        score = word_similarity(filters.query.casefold())(F.lower("title"))
        return [score.desc_nulls_last(), F.asc("id")]
    if sort == "salary_desc":
        return [F.when(comparable_salary(), F.col("salary_monthly_max")).desc_nulls_last(), F.asc("id")]
    if sort == "title":
        return [F.lower("title").asc_nulls_last(), F.asc("id")]
    if sort == "company":
        return [F.lower("company_name").asc_nulls_last(), F.asc("id")]
    age = F.coalesce("posted_age_days", F.lit(0))
    posted_on = F.coalesce("published_at", F.col("last_seen_at") - F.make_dt_interval(age))
    expired = F.when(F.col("expires_at") < F.lit(as_of).cast("timestamp"), 1).otherwise(0)
    return [expired.asc(), posted_on.desc_nulls_first(), F.asc("id")]


def search_jobs(
    jobs: DataFrame, filters: JobFilters | None = None, sort: str = "newest", page: int = 1,
    page_size: int = 20, as_of=None, window_days: int = limits.LIFECYCLE_DAYS,
) -> DataFrame:
    """One page of the filtered jobs plus ``total``. Sort, offset and limit plan as a top-k."""
    hits = apply_filters(jobs, filters, as_of, window_days)
    total = hits.agg(F.count("*")).scalar()
    paged = hits.orderBy(*sort_keys(sort, as_of, filters)).offset((page - 1) * page_size).limit(page_size)
    return paged.withColumn("total", total)


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """A stable page of any table (run and audit lists)."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def seeded_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows in a repeatable pseudo-random order of ``key`` (a top-k, no full sort)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)


def top_share(df: DataFrame, key: str, k: int, digits: int = 4) -> DataFrame:
    """Share of all rows (with a key) that the ``k`` largest keys hold."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n")).limit(k).agg(F.sum("n").alias("top"))
    return top.select(F.round(F.col("top") / counts.agg(F.sum("n")).scalar(), digits).alias("share"))
