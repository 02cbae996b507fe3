"""Site policy, source eligibility, candidate triage, low-yield skipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.urls import is_job_url
from postlake.rules import limits, sites, vocab


def review_table(spark: SparkSession, rows=None) -> DataFrame:
    """(domain, status, aggregator) of reviewed sites: a fixed list of a few dozen rows."""
    return spark.createDataFrame(rows or sites.REVIEWS, "domain string, status string, aggregator boolean")


def excluded_table(spark: SparkSession, domains=sites.EXCLUDED_DOMAINS) -> DataFrame:
    return spark.createDataFrame([(d,) for d in domains], "domain string")


def usable_captures(
    df: DataFrame, domain: str = "source_domain", source: str = "registry_source_id",
    excluded=sites.EXCLUDED_DOMAINS, usable=None, archive: str = sites.ARCHIVE_SOURCE,
) -> DataFrame:
    """Default deny: no excluded site, and archive rows only from sites with a usable review.

    Both lists are fixed values, so they are literal sets the scan can filter on. A NULL
    domain is dropped.
    """
    if usable is None:
        usable = [d for d, status, _ in sites.REVIEWS if status in sites.USABLE_REVIEWS]
    name = F.lower(domain)
    reviewed = name.isin(*usable) if usable else F.lit(False)
    return df.filter(~name.isin(*excluded)).filter((F.col(source) != archive) | reviewed)


def job_candidates(index: DataFrame, excluded=sites.EXCLUDED_DOMAINS, crawl: str | None = None) -> DataFrame:
    """Index rows worth fetching: status 200, HTML, a job-like URL, no excluded site."""
    hits = index.filter(
        (F.col("fetch_status") == 200) & (F.col("content_mime_detected") == "text/html") & is_job_url("url")
        & F.col("url_host_registered_domain").isNotNull()
        & ~F.lower("url_host_registered_domain").isin(*excluded)
    )
    return hits.select(
        F.lit(crawl).alias("crawl"), "url", F.col("url_host_registered_domain").alias("domain"), "fetch_time",
        "content_digest", "warc_filename", "warc_record_offset", "warc_record_length",
    )


def index_range(index: DataFrame, key: str = "url_surtkey", start=sites.INDEX_KEY_START, end=sites.INDEX_KEY_END) -> DataFrame:
    """Rows in a key range; on a sorted key Parquet skips the other row groups and files."""
    return index.filter((F.col(key) >= start) & (F.col(key) < end))


def refusal_reason(mode: Column | str, as_of, valid_days: int = limits.REVIEW_VALID_DAYS) -> Column:
    """Why a source may not run now, or NULL when it may."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    age = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(valid_days))
    collecting = mode == "collect"
    return (
        F.when(~F.col("permission_status").isin(*vocab.RUNNABLE_PERMISSION), "not approved")
        .when(F.col("is_paused"), "paused by an operator")
        .when(F.col("connector").isNull(), "no connector configured")
        .when(collecting & F.col("reviewed_at").isNull(), "no recorded policy review")
        .when(collecting & (F.col("reviewed_at") < age), "policy review has expired")
    )


def can_resume() -> Column:
    return F.col("permission_status").isin(*vocab.RUNNABLE_PERMISSION)


def domain_yield(captures: DataFrame) -> DataFrame:
    """Pages tried and pages with postings per domain."""
    return captures.filter(F.col("fetch_result") == "ok").groupBy("domain").agg(
        F.count("*").alias("tried"), F.count_if(F.col("jobposting_count") > 0).alias("hits")
    )


def triage(candidates: DataFrame, captures: DataFrame, reobservations: DataFrame, crawl: str) -> DataFrame:
    """Add ``triage``: already_fetched, reobserved or pending.

    Fetched positions and re-observations of this crawl, and page contents of any crawl,
    are three distinct key sets joined by key; nothing is held on the driver.
    """
    fetched = captures.filter((F.col("crawl") == crawl) & ~F.col("fetch_result").isin(*sites.TRANSIENT_RESULTS))
    fetched = fetched.select("warc_filename", "warc_record_offset").distinct().withColumn("fetched", F.lit(True))
    known = reobservations.filter(F.col("crawl") == crawl).select("url", "content_digest").distinct()
    seen = captures.filter(F.col("fetch_result") == "ok").select("url", "content_digest").distinct()
    # One key set for both page-content tests: a page is known, seen, or both.
    pages = (
        known.withColumn("kind", F.lit(2)).unionByName(seen.withColumn("kind", F.lit(1)))
        .groupBy("url", "content_digest").agg(F.max("kind").alias("kind"))
    )
    return (
        candidates.join(fetched, ["warc_filename", "warc_record_offset"], "left")
        .join(pages, ["url", "content_digest"], "left")
        .withColumn(
            "triage",
            F.when(F.col("fetched") | (F.col("kind") == 2), "already_fetched")
            .when(F.col("kind") == 1, "reobserved").otherwise("pending"),
        )
        .drop("fetched", "kind")
    )


def fetch_order(pending: DataFrame, yields: DataFrame, trials: int = limits.DOMAIN_TRIALS, seed: int = 20261017) -> DataFrame:
    """Pending pages without low-yield domains, proven domains first, the rest in a seeded
    shuffle. Yields are those known before the batch."""
    rated = pending.join(yields, "domain", "left").withColumns(
        {"tried": F.coalesce("tried", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))}
    )
    kept = rated.filter(~((F.col("tried") >= trials) & (F.col("hits") == 0)))
    rate = F.when(F.col("tried") > 0, F.col("hits") / F.col("tried")).otherwise(0.0)
    return kept.withColumn("yield_rate", rate).orderBy(
        F.desc("yield_rate"), F.xxhash64(F.col("url"), F.lit(seed)), "url"
    )


def skipped_low_yield(pending: DataFrame, yields: DataFrame, trials: int = limits.DOMAIN_TRIALS) -> DataFrame:
    low = yields.filter((F.col("tried") >= trials) & (F.col("hits") == 0))
    return pending.join(low.select("domain"), "domain", "left_semi")


def domain_governance(observations: DataFrame, reviews: DataFrame, excluded=sites.EXCLUDED_DOMAINS,
                      archive: str = sites.ARCHIVE_SOURCE) -> DataFrame:
    """(status, domain, observations) of the archive's sites, excluded ones included: one row per site."""
    per_domain = observations.filter(F.col("registry_source_id") == archive).groupBy(
        F.lower("source_domain").alias("domain")
    ).agg(F.count("*").alias("n"))
    status = F.when(F.col("domain").isin(*excluded), "excluded_portal").otherwise(
        F.coalesce("status", F.lit("unreviewed"))
    )
    return per_domain.join(reviews.select("domain", "status"), "domain", "left").select(
        status.alias("status"), "domain", F.col("n").alias("observations"))


def governance_totals(governed: DataFrame) -> DataFrame:
    """Observations and number of sites per review status."""
    return governed.groupBy("status").agg(F.sum("observations").alias("observations"), F.count("*").alias("domains"))
