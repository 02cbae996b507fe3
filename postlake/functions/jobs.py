"""Serving-row normalization: a source's record columns to the canonical job columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.attributes import (
    education_level, employment_type, parse_experience, parse_posting_age, split_card_tags,
)
from postlake.functions.classify import role_family
from postlake.functions.places import parse_location
from postlake.functions.salary import evaluate_amounts, parse_salary
from postlake.functions.text import as_column, clean_text, lookup, normalize_for_matching
from postlake.functions.urls import validated_url
from postlake.rules.words import ARRANGEMENT_TEXT, NORMALIZATION_VERSION

# Columns a source may provide; the ones it lacks are taken as NULL.
SOURCE_COLUMNS = {
    "source_key": "string", "source_key_kind": "string", "title": "string",
    "company_name": "string", "location_text": "string", "salary_text": "string",
    "structured_salary": "struct<minimum:bigint,maximum:bigint,currency:string,period:string>",
    "employment_type_text": "string", "work_arrangement_text": "string",
    "experience_text": "string", "education_text": "string", "tags": "array<string>",
    "description": "string", "posted_text": "string", "published_at": "timestamp",
    "expires_at": "timestamp", "source_url": "string", "raw_fields": "map<string,string>",
    "first_observed_at": "timestamp", "last_observed_at": "timestamp",
}


def job_fingerprint(title: Column | str, company: Column | str, place: Column | str) -> Column:
    """SHA-256 of the folded title, company and place."""
    parts = [normalize_for_matching(v) for v in (title, company, place)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_hash(raw_fields: Column | str) -> Column:
    """SHA-256 of a map's entries as JSON, keys sorted."""
    entries = F.array_sort(F.map_entries(as_column(raw_fields)))
    return F.sha2(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}), 256)


def with_source_columns(df: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in SOURCE_COLUMNS.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def normalize_source_jobs(
    df: DataFrame, currency: str | None = None, period: str | None = None
) -> DataFrame:
    """Canonical columns, ``fingerprint``, ``content_hash`` and ``reject_reason``.

    ``currency`` and ``period`` state the source's documented salary convention. Records
    without a title are kept with a ``reject_reason`` so the caller can count and split them.
    """
    s = with_source_columns(df)
    c = F.col
    texts = {
        "n_title": "title", "n_company": "company_name", "n_location": "location_text",
        "n_salary": "salary_text", "n_employment": "employment_type_text",
        "n_experience": "experience_text", "n_education": "education_text",
        "n_description": "description", "n_posted": "posted_text", "n_work": "work_arrangement_text",
    }
    s = s.withColumns({new: clean_text(old) for new, old in texts.items()})
    structured = c("structured_salary")
    s = s.withColumns(
        {
            "loc": parse_location("n_location", cleaned=True),
            "tag": split_card_tags("tags"),
            "exp": parse_experience("n_experience"),
            "age": parse_posting_age("n_posted"),
            "role_family": role_family("n_title"),
            "pay": F.when(
                structured.isNotNull(),
                evaluate_amounts(structured["minimum"], structured["maximum"],
                                 structured["currency"], structured["period"]),
            ).otherwise(parse_salary("n_salary", currency, period, cleaned=True)),
            "explicit": lookup(ARRANGEMENT_TEXT, normalize_for_matching("work_arrangement_text")),
            "url": validated_url("source_url"),
        }
    )
    disclosed = c("pay.status") == "DISCLOSED"
    by_place = (c("tag.work_arrangement") == "UNKNOWN") & c("loc.is_remote")
    unresolved = (c("loc.confidence") == "UNKNOWN") & ~c("loc.is_remote")
    bad_url = c("source_url").isNotNull() & (c("source_url") != "") & c("url").isNull()
    flags = F.array_sort(
        F.array_distinct(
            F.concat(
                c("pay.flags"),
                F.array_compact(
                    F.array(
                        F.when(c("pay.period_assumed"), "SALARY_PERIOD_ASSUMED"),
                        F.when(unresolved, "LOCATION_UNRESOLVED"),
                        F.when(c("role_family") == "OTHER", "ROLE_UNCLASSIFIED"),
                        F.when(c("tag.hidden_count") > 0, "TAGS_TRUNCATED"),
                        F.when(c("age.approximate"), "POSTING_AGE_APPROXIMATE"),
                        F.when(bad_url, "INVALID_SOURCE_URL"),
                    )
                ),
            )
        )
    )
    values = {
        "title": c("n_title"),
        "role_family": c("role_family"),
        "company_name": c("n_company"),
        "location_text": c("n_location"),
        "city": c("loc.city"),
        "province": c("loc.province"),
        "location_confidence": c("loc.confidence"),
        "employment_type_text": c("n_employment"),
        "employment_type": employment_type("n_employment"),
        "work_arrangement": F.coalesce(
            c("explicit"), F.when(by_place, "REMOTE"), c("tag.work_arrangement")
        ),
        "work_arrangement_evidence": F.when(c("explicit").isNotNull(), c("n_work"))
        .when(by_place, c("n_location")).otherwise(c("tag.evidence")),
        "experience_text": c("n_experience"),
        "experience_min_years": c("exp.min_years"),
        "experience_max_years": c("exp.max_years"),
        "experience_band": c("exp.band"),
        "education_text": c("n_education"),
        "education_level": education_level("n_education", cleaned=True),
        "salary_text": c("n_salary"),
        "salary_status": c("pay.status"),
        "salary_min": F.when(disclosed, c("pay.minimum")),
        "salary_max": F.when(disclosed, c("pay.maximum")),
        "salary_currency": F.when(disclosed, c("pay.currency")),
        "salary_period": c("pay.period"),
        "salary_period_assumed": c("pay.period_assumed"),
        "salary_monthly_min": F.when(disclosed, c("pay.monthly_minimum")),
        "salary_monthly_max": F.when(disclosed, c("pay.monthly_maximum")),
        "source_tags": c("tag.skills"),
        "hidden_tag_count": c("tag.hidden_count"),
        "description": c("n_description"),
        "posted_text": c("n_posted"),
        "posted_age_days": c("age.days"),
        "is_urgent": c("age.is_urgent"),
        "published_at": c("published_at"),
        "expires_at": c("expires_at"),
        "source_url": c("url"),
        "quality_flags": flags,
        "normalization_version": F.lit(NORMALIZATION_VERSION),
        "search_text": F.lower(
            F.concat_ws(" ", c("n_title"), c("n_company"), c("n_location"), c("tag.skills"))
        ),
    }
    kept = ("source_key", "source_key_kind", "raw_fields", "first_observed_at", "last_observed_at")
    extra = [n for n in df.columns if n not in SOURCE_COLUMNS]
    return s.select(
        *extra, *kept, *[v.alias(n) for n, v in values.items()],
        job_fingerprint("n_title", "n_company", F.coalesce("loc.city", "loc.province")).alias("fingerprint"),
        content_hash("raw_fields").alias("content_hash"),
        F.when(c("n_title").isNull(), "record has no job title").alias("reject_reason"),
    )
