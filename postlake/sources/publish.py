"""Canonical vacancies to the source-record columns of the serving tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import schemas
from postlake.functions.text import as_column, lookup
from postlake.rules.sites import REVIEWS
from postlake.rules.words import (
    EDUCATION_TEXT, IMPLAUSIBLE_PAY_TEXT, REASON_BELOW_FLOOR, REASON_SITE_TEMPLATE, TEMPLATE_PAY_TEXT,
)

ZONE = "Asia/Jakarta"


def end_of_day(date: Column | str, zone: str = ZONE) -> Column:
    """Last second of the local day: sites mean 'open through this day'."""
    stamp = F.concat(F.date_format(as_column(date), "yyyy-MM-dd"), F.lit(" 23:59:59"))
    return F.to_utc_timestamp(F.to_timestamp(stamp), zone)


def vacancy_source_jobs(vacancies: DataFrame, registry_source_id: str) -> DataFrame:
    """One record per vacancy whose representative the source supplied.

    Untrusted pay becomes an explanation without digits; a template deadline stays in the raw
    fields only.
    """
    v = schemas.required_columns(vacancies, schemas.PUBLISH_COLUMNS, "vacancies")
    c = F.col
    v = v.filter(c("registry_source_id") == registry_source_id)
    low, high = c("salary_monthly_min"), c("salary_monthly_max")
    trusted = F.coalesce(c("salary_reliable") & (low <= high), F.lit(False))
    doubtful = c("valid_through").isNotNull() & ~c("valid_through_reliable")
    reasons = {REASON_SITE_TEMPLATE: TEMPLATE_PAY_TEXT, REASON_BELOW_FLOOR: IMPLAUSIBLE_PAY_TEXT}
    place = F.concat_ws(", ", "city", "province")
    raw = {
        "vacancy_id": c("vacancy_id"), "sites": F.to_json("sites"), "source_records": c("source_records"),
        "city_templated": c("city_templated"), "source_title": c("source_title"),
        "aggregator_site": F.coalesce(F.lower("source_domain").isin([d for d, _, aggregator in REVIEWS if aggregator]), F.lit(False)),
        "parser_version": c("parser_version"), "source_valid_through": c("valid_through"),
        "valid_through_unreliable": doubtful,
    }
    return v.select(
        c("vacancy_id").alias("source_key"), F.lit("content_fingerprint").alias("source_key_kind"),
        "title", c("organization").alias("company_name"),
        F.when(place != "", place).alias("location_text"),
        F.when(
            trusted,
            F.struct(low.alias("minimum"), high.alias("maximum"), F.lit("IDR").alias("currency"),
                     F.lit("MONTH").alias("period")),
        ).alias("structured_salary"),
        F.when(~trusted, lookup(reasons, c("salary_unreliable_reason"))).alias("salary_text"),
        c("employment_type_raw").alias("employment_type_text"),
        F.when(c("work_arrangement") == "REMOTE", "remote").alias("work_arrangement_text"),
        F.when(
            c("experience_min_years").isNotNull(),
            F.concat(F.lit("minimal "), c("experience_min_years").cast("string"), F.lit(" tahun")),
        ).alias("experience_text"),
        lookup(EDUCATION_TEXT, c("education_level")).alias("education_text"),
        c("date_posted").cast("timestamp").alias("published_at"),
        F.when(~doubtful, end_of_day("valid_through")).alias("expires_at"),
        c("canonical_url").alias("source_url"),
        c("first_seen_at").alias("first_observed_at"), c("last_seen_at").alias("last_observed_at"),
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in raw]), F.array(*[x.cast("string") for x in raw.values()])
        ).alias("raw_fields"),
    )
