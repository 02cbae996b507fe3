"""Market overview, dataset scope, source coverage, serving-row projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import lookup
from postlake.functions.urls import publisher_site, safe_link
from postlake.operators.filters import JobFilters, apply_filters, lifecycle
from postlake.operators.pay_rule import comparable_salary
from postlake.rules import limits, vocab


def overview(
    jobs: DataFrame, records: DataFrame, filters: JobFilters | None = None, as_of=None,
    window_days: int = limits.LIFECYCLE_DAYS,
) -> DataFrame:
    """One row of counts over the filtered jobs; ``records`` (job_id) counts backing records.

    Jobs are first reduced to the combinations of the counted columns (map-side, as every aggregate); only
    those are expanded once per distinct count, not the jobs.
    """
    jobs = apply_filters(jobs, filters, as_of, window_days)
    backed = records.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    counted = {
        "companies": F.lower("company_name"), "cities": F.col("city"), "provinces": F.col("province"),
        "sources_with_jobs": F.col("primary_source_id"), "publisher_sites": publisher_site("source_url"),
    }
    combinations = jobs.groupBy(*[c.alias(n) for n, c in counted.items()]).agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("salary_status") == "DISCLOSED").alias("salary_disclosed"),
        F.count_if(F.col("work_arrangement").isin("REMOTE", "HYBRID")).alias("remote_or_hybrid"),
        F.min("last_seen_at").alias("observed_from"),
        F.max("last_seen_at").alias("observed_to"),
    )
    out = combinations.agg(
        F.coalesce(F.sum("total_jobs"), F.lit(0)).alias("total_jobs"),
        *[F.count_distinct(n).alias(n) for n in counted],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("salary_disclosed", "remote_or_hybrid")],
        F.min("observed_from").alias("observed_from"), F.max("observed_to").alias("observed_to"),
    )
    return out.withColumn("total_source_records", backed.agg(F.count("*")).scalar())


def observation_method(technical_method: Column) -> Column:
    return (
        F.when(technical_method == "archive_index", "ARCHIVE")
        .when(technical_method == "manual_import", "SNAPSHOT").otherwise("LIVE")
    )


def dataset_scope(
    jobs: DataFrame, sources: DataFrame, filters: JobFilters | None, as_of,
    window_days: int = limits.LIFECYCLE_DAYS,
) -> DataFrame:
    """One row: observed and published ranges, and how many sources contribute (see scope_sources for which)."""
    jobs = apply_filters(jobs, filters, as_of, window_days)
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(window_days))
    used = sources.join(jobs.select(F.col("primary_source_id").alias("id")), "id", "left_semi")
    listed = used.agg(F.count("*").alias("sources"), F.count("coverage_note").alias("coverage_notes"))
    out = jobs.agg(
        F.min("last_seen_at").alias("observed_from"), F.max("last_seen_at").alias("observed_to"),
        F.min("published_at").alias("published_from"), F.max("published_at").alias("published_to"),
        F.count_distinct(publisher_site("source_url")).alias("publisher_sites"),
    )
    return out.withColumns(
        {
            "is_historical": F.coalesce(F.col("observed_to") < cutoff, F.lit(True)),
            "sources": listed.select("sources").scalar(),
            "coverage_notes": listed.select("coverage_notes").scalar(),
        }
    )


def scope_sources(
    jobs: DataFrame, sources: DataFrame, filters: JobFilters | None, as_of, window_days: int = limits.LIFECYCLE_DAYS,
) -> DataFrame:
    """(id, name, coverage_note) of the sources that contribute to the filtered jobs."""
    jobs = apply_filters(jobs, filters, as_of, window_days)
    used = jobs.select(F.col("primary_source_id").alias("id"))
    return sources.join(used, "id", "left_semi").select("id", "name", "coverage_note")


def source_coverage(sources: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every registered source with its job count and last successful run."""
    counts = jobs.groupBy(F.col("primary_source_id").alias("id")).agg(F.count("*").alias("job_count"))
    success = (
        runs.filter(F.col("status") == "SUCCEEDED").groupBy(F.col("source_id").alias("id"))
        .agg(F.max("finished_at").alias("last_success_at"))
    )
    return (
        sources.join(counts, "id", "left").join(success, "id", "left")
        .withColumn("job_count", F.coalesce("job_count", F.lit(0)))
        .orderBy(F.desc("job_count"), "permission_status", F.lower("name"))
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The greatest row per key by ``order`` (ties: by the whole row), with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("m")
    return df.groupBy(*keys).agg(best).select(*keys, "m.r.*")


def admin_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry rows with their latest run and last success."""
    latest = latest_per_key(runs.select("source_id", "status", "started_at"), ["source_id"], [F.col("started_at")])
    success = (
        runs.filter(F.col("status") == "SUCCEEDED").groupBy("source_id")
        .agg(F.max("finished_at").alias("last_success_at"))
    )
    latest = latest.select(
        F.col("source_id").alias("id"), F.col("status").alias("last_run_status"),
        F.col("started_at").alias("last_run_at"),
    )
    return (
        sources.join(latest, "id", "left")
        .join(success.withColumnRenamed("source_id", "id"), "id", "left").orderBy("id")
    )


def coded(column: str, labels: dict[str, str]) -> Column:
    code = F.col(column)
    return F.struct(code.alias("code"), lookup(labels, code).alias("label"))


def archive_evidence(raw: Column | str = "raw_fields") -> Column:
    """What the archive saw, from the raw map; NULL when it carries no such fields."""
    raw = F.col(raw) if isinstance(raw, str) else raw

    def entry(name: str) -> Column:
        return F.try_element_at(raw, F.lit(name))

    def yes(name: str) -> Column:
        return F.coalesce(entry(name) == "true", F.lit(False))

    return F.when(
        entry("source_records").isNotNull() & entry("sites").isNotNull(),
        F.struct(
            entry("source_records").try_cast("int").alias("pages"),
            F.from_json(entry("sites"), "array<string>").alias("sites"),
            yes("city_templated").alias("city_templated"),
            entry("source_title").alias("source_title"),
            yes("aggregator_site").alias("aggregator_site"),
            yes("valid_through_unreliable").alias("deadline_unreliable"),
            entry("source_valid_through").alias("source_valid_through"),
        ),
    )


def job_summaries(jobs: DataFrame, sources: DataFrame, as_of, window_days: int = limits.LIFECYCLE_DAYS) -> DataFrame:
    """Listing rows: codes with labels, nested salary and location, safe link, lifecycle."""
    fresh = lifecycle(as_of, window_days)
    registry = sources.select(
        F.col("id").alias("primary_source_id"),
        F.struct(
            "id", "name", F.col("attribution_text").alias("attribution"),
            observation_method(F.col("technical_method")).alias("method"),
        ).alias("source"),
    )
    return jobs.join(registry, "primary_source_id", "left").select(
        "id", "title", "company_name",
        coded("role_family", vocab.ROLE_FAMILY).alias("role_family"),
        F.struct(F.col("location_text").alias("text"), "city", "province",
                 F.col("location_confidence").alias("confidence")).alias("location"),
        coded("employment_type", vocab.EMPLOYMENT_TYPE).alias("employment_type"),
        coded("work_arrangement", vocab.WORK_ARRANGEMENT).alias("work_arrangement"),
        F.struct(F.col("experience_text").alias("text"), F.col("experience_min_years").alias("min_years"),
                 F.col("experience_max_years").alias("max_years"),
                 coded("experience_band", vocab.EXPERIENCE_BAND).alias("band")).alias("experience"),
        coded("education_level", vocab.EDUCATION_LEVEL).alias("education"),
        F.struct(
            coded("salary_status", vocab.SALARY_STATUS).alias("status"), F.col("salary_text").alias("text"),
            F.col("salary_min").alias("min"), F.col("salary_max").alias("max"),
            F.col("salary_currency").alias("currency"), coded("salary_period", vocab.SALARY_PERIOD).alias("period"),
            F.col("salary_period_assumed").alias("period_assumed"),
            F.col("salary_monthly_min").alias("monthly_min"), F.col("salary_monthly_max").alias("monthly_max"),
            comparable_salary().alias("comparable"),
        ).alias("salary"),
        "source_tags", "hidden_tag_count", "is_urgent", "posted_text", "posted_age_days", "published_at",
        "expires_at", "last_seen_at",
        F.struct(fresh.alias("code"), lookup(vocab.FRESHNESS, fresh).alias("label")).alias("freshness"),
        "source", safe_link("source_url").alias("source_url"),
    )


def job_detail(jobs: DataFrame, records: DataFrame, sources: DataFrame, job_id) -> DataFrame:
    """One job with all its source records and their sources' names."""
    mine = records.filter(F.col("job_id") == job_id).join(
        sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left"
    )
    grouped = mine.groupBy("job_id").agg(
        F.array_sort(
            F.collect_list(F.struct("source_id", "source_key", "source_name", "first_seen_at", "last_seen_at"))
        ).alias("source_records")
    )
    return jobs.filter(F.col("id") == job_id).join(
        grouped.withColumnRenamed("job_id", "id"), "id", "left"
    )
