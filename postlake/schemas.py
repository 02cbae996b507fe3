"""Explicit schemas of the stored tables and the check for missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

CAPTURE = (
    "crawl string, url string, domain string, index_fetch_time timestamp, content_digest string, "
    "warc_filename string, warc_record_offset bigint, warc_record_length bigint, captured_at timestamp, "
    "http_status int, fetch_result string, jobposting_count int, malformed_jsonld int, postings_json string, "
    "fetched_at timestamp, connector_version string"
)
REOBSERVATION = (
    "crawl string, url string, domain string, index_fetch_time timestamp, content_digest string"
)
CANDIDATE = (
    "crawl string, url string, domain string, fetch_time timestamp, content_digest string, "
    "warc_filename string, warc_record_offset bigint, warc_record_length bigint"
)
OBSERVATION_COLUMNS = (
    "observation_type", "registry_source_id", "crawl", "captured_at", "bronze_file", "warc_filename",
    "warc_record_offset", "content_digest", "source_record_key", "record_key_kind", "source_domain",
    "site_type", "canonical_url", "page_url", "posting_position", "source_identifier", "title",
    "source_title", "title_key", "organization", "organization_key", "role_family", "city", "province",
    "locality_raw", "region_raw", "country_raw", "location_count", "provinces", "employment_type_raw",
    "employment_type", "work_arrangement", "experience_min_years", "education_level", "date_posted",
    "valid_through", "salary_status", "salary_currency", "salary_unit_raw", "salary_period", "salary_min",
    "salary_max", "salary_monthly_min", "salary_monthly_max", "description_length", "description_sha1",
    "skills", "is_valid", "invalid_reasons", "quality_flags", "parser_version",
)
SNAPSHOT_COLUMNS = (
    "job_title", "company_name", "location", "salary_range", "job_type", "experience_level",
    "education_req", "job_requirements", "posted_date", "source_platform",
)
LABEL_COLUMNS = ("job_id", "title", "source", "reviewer_a", "reviewer_b", "adjudicated")
PUBLISH_COLUMNS = (
    "vacancy_id", "registry_source_id", "title", "organization", "canonical_url", "first_seen_at",
    "last_seen_at", "salary_reliable", "salary_unreliable_reason", "valid_through_reliable",
)
BOARD_POSTING = (
    "id string, text string, categories struct<location:string,commitment:string,team:string>, "
    "workplaceType string, salaryRange struct<currency:string,interval:string,min:double,max:double>, "
    "hostedUrl string, createdAt bigint, descriptionPlain string"
)


def strings(columns) -> str:
    return ", ".join(f"{c} string" for c in columns)


def required_columns(df: DataFrame, columns, what: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df
