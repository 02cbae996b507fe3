"""Counts by dimension with denominators, and the filter options built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import lookup
from postlake.operators.filters import JobFilters, apply_filters, lifecycle
from postlake.operators.pay_rule import comparable_salary
from postlake.rules import limits, vocab

# dimension -> (job column, labels or None for the value itself)
DIMENSIONS = {
    "province": ("province", None),
    "city": ("city", None),
    "role_family": ("role_family", vocab.ROLE_FAMILY),
    "employment_type": ("employment_type", vocab.EMPLOYMENT_TYPE),
    "work_arrangement": ("work_arrangement", vocab.WORK_ARRANGEMENT),
    "education": ("education_level", vocab.EDUCATION_LEVEL),
    "experience": ("experience_band", vocab.EXPERIENCE_BAND),
    "company": ("company_name", None),
    "title": ("title", None),
    "source": ("primary_source_id", None),
}


def label_of(key: Column, labels: dict[str, str] | None) -> Column:
    own = F.coalesce(key.cast("string"), F.lit(vocab.MISSING_LABEL))
    return own if labels is None else F.coalesce(lookup(labels, key), own)


def top_with_remainder(counts: DataFrame, count: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` groups, each with ``total`` and ``distinct_values`` of the whole set and
    ``other_count``, what the groups beyond the limit hold."""
    totals = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total"), F.count("*").alias("distinct_values"))
    # At most ``limit`` rows remain, so this whole-frame window is bounded.
    shown = F.sum(count).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = counts.orderBy(*order).limit(limit)
    return top.withColumns(
        {"total": totals.select("total").scalar(), "distinct_values": totals.select("distinct_values").scalar()}
    ).withColumn("other_count", F.col("total") - shown)


def breakdown(
    jobs: DataFrame, dimension: str, filters: JobFilters | None = None, limit: int = 10,
    as_of=None, window_days: int = limits.LIFECYCLE_DAYS, sources: DataFrame | None = None,
) -> DataFrame:
    """The ``limit`` largest categories: key, label, count, share, and for the whole set
    total, distinct_values and other_count (jobs in categories beyond the limit).

    ``sources`` (id, name) names the categories of the source dimension.
    """
    column, labels = DIMENSIONS[dimension]
    counts = apply_filters(jobs, filters, as_of, window_days).groupBy(F.col(column).alias("key")).agg(
        F.count("*").alias("count")
    )
    top = top_with_remainder(counts, "count", [F.desc("count"), F.asc_nulls_last("key")], limit)
    out = top.withColumns({"label": label_of(F.col("key"), labels), "share": F.col("count") / F.col("total")})
    if dimension == "source" and sources is not None:
        named = sources.select(F.col("id").alias("source_id"), "name")
        out = out.join(named, F.col("key") == F.col("source_id"), "left").withColumn(
            "label", F.coalesce("name", "label")
        )
    return out.select("key", "label", "count", "share", "total", "distinct_values", "other_count")


def filter_options(jobs: DataFrame, as_of, limit: int | None = None, window_days: int = limits.LIFECYCLE_DAYS,
                   dimensions=("province", "city", "role_family", "employment_type", "work_arrangement",
                               "education", "experience", "source")) -> DataFrame:
    """Long form (dimension, key, count): all values of each dimension and the lifecycle labels.
    One pass over the jobs: values are unpivoted before a single count. With a limit only the
    most common values stay, and each row says how many values its dimension has
    (distinct_values) and how many jobs the others hold (other_count)."""
    pairs = [(d, F.col(DIMENSIONS[d][0])) for d in dimensions]
    pairs.append(("freshness", lifecycle(as_of, window_days)))
    long = jobs.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("key")) for d, v in pairs]))
        .alias("o")
    ).select("o.*").filter(F.col("key").isNotNull())
    counts = long.groupBy("dimension", "key").agg(F.count("*").alias("count"))
    if limit is None:
        return counts
    # Top values per dimension without ranking a whole dimension in one task: prune per
    # hashed slice first, then rank the few survivors.
    shown = top_per_group(counts, ["dimension"], [F.desc("count"), F.asc("key")], limit)
    whole = counts.groupBy("dimension").agg(F.count("*").alias("distinct_values"), F.sum("count").alias("all"))
    kept = shown.groupBy("dimension").agg(F.sum("count").alias("kept"))
    rest = whole.join(kept, "dimension").select("dimension", "distinct_values", (F.col("all") - F.col("kept")).alias("other_count"))
    return shown.join(rest, "dimension")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, slices: int = 64) -> DataFrame:
    """First ``limit`` rows per key in two steps, so a hot key is ranked by many tasks."""
    salted = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= limit)
        .drop("_rank", "_slice")
    )


def salary_bounds(jobs: DataFrame) -> DataFrame:
    """Range offered by the salary filter: comparable salaries only."""
    return jobs.filter(comparable_salary()).agg(
        F.min("salary_monthly_min").alias("salary_monthly_from"),
        F.max("salary_monthly_max").alias("salary_monthly_to"),
    )
