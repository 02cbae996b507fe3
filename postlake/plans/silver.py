"""Bronze captures to observations, source records and vacancies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.jsonld import extract_job_postings
from postlake.functions.postings import normalize_postings
from postlake.operators.policy import usable_captures
from postlake.operators.records import source_records, with_reobservations
from postlake.operators.templates import mark_deadline_templates, mark_salary_templates
from postlake.operators.vacancies import collapse_vacancies, member_table, vacancy_members
from postlake.rules.sites import EXCLUDED_DOMAINS
from postlake.schemas import OBSERVATION_COLUMNS
from postlake.session import cut_lineage


@dataclass(frozen=True)
class Silver:
    observations: DataFrame
    records: DataFrame
    vacancies: DataFrame
    members: DataFrame


def explode_postings(captures: DataFrame) -> DataFrame:
    """One row per JobPosting of the pages that were fetched, with its position."""
    pages = captures.filter((F.col("fetch_result") == "ok") & F.col("postings_json").isNotNull())
    items = F.from_json("postings_json", "array<variant>")
    return pages.select("*", F.posexplode(items).alias("position", "item")).withColumn(
        "posting", F.to_json("item")
    ).drop("item", "postings_json")


def capture_pages(records: DataFrame, crawl: str, version: str = "archive-jobposting/1") -> DataFrame:
    """Archive records (url, body, times) to capture columns: only JobPosting objects are kept."""
    found = records.withColumn("ld", extract_job_postings("body"))
    return found.select(
        F.lit(crawl).alias("crawl"), "url", "domain", "content_digest", "warc_filename", "warc_record_offset",
        "warc_record_length", "captured_at", "http_status", F.coalesce("reject_reason", F.lit("ok")).alias("fetch_result"),
        F.size("ld.postings").alias("jobposting_count"), F.col("ld.malformed").alias("malformed_jsonld"),
        F.when(
            F.size("ld.postings") > 0, F.concat(F.lit("["), F.array_join("ld.postings", ","), F.lit("]"))
        ).alias("postings_json"),
        F.current_timestamp().alias("fetched_at"), F.lit(version).alias("connector_version"),
    )


def parse_captures(captures: DataFrame) -> DataFrame:
    """Observation rows (fixed column set) of every posting in the captures."""
    rows = normalize_postings(explode_postings(captures).withColumnRenamed("url", "page_url"))
    return rows.withColumn("observation_type", F.lit("capture")).select(*OBSERVATION_COLUMNS)


def observations_and_rejects(captures: DataFrame) -> DataFrame:
    """Observation rows (kind 'observation') and captures that could not be fetched (kind 'reject') in one pass.

    A reject has the capture's own columns (page_url, bronze_file, captured_at, fetch_result) and no posting.
    """
    good = F.coalesce(F.col("fetch_result") == "ok", F.lit(False))
    items = F.when(good, F.from_json("postings_json", "array<variant>"))
    rows = captures.select("*", good.alias("good"), F.posexplode_outer(items).alias("position", "item"))
    rows = rows.filter(~F.col("good") | F.col("item").isNotNull()).withColumn("posting", F.to_json("item")).drop("item", "postings_json")
    kind = F.when(F.col("good"), "observation").otherwise("reject")
    parsed = normalize_postings(rows.withColumnRenamed("url", "page_url")).withColumn("observation_type", F.lit("capture"))
    return parsed.select(kind.alias("kind"), *OBSERVATION_COLUMNS, "fetch_result")


def build_silver(
    observations: DataFrame, reobservations: DataFrame | None = None, excluded=EXCLUDED_DOMAINS, usable=None,
) -> Silver:
    """``observations`` are parsed captures; the site policy is applied here on every build, so
    a site excluded later disappears."""
    usable_rows = usable_captures(observations, excluded=excluded, usable=usable)
    everything = with_reobservations(usable_rows, reobservations) if reobservations is not None else usable_rows
    records = mark_deadline_templates(mark_salary_templates(cut_lineage(source_records(everything))))
    records = cut_lineage(records)
    members = cut_lineage(vacancy_members(records))
    vacancies = collapse_vacancies(records, members)
    return Silver(everything, records, vacancies, member_table(members))
