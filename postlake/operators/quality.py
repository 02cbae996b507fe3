"""Completeness, inventory, flags, reconciliation, constraints: one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.pay_rule import reliable_salary
from postlake.rules import limits


def unpivot(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """A one-row report as (name, value) rows."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def shares(df: DataFrame, checks: dict[str, Column], digits: int = 4) -> DataFrame:
    """(field, share): mean of each condition; rows where a condition is NULL do not count."""
    means = df.agg(*[F.round(F.avg(c.cast("int")), digits).alias(n) for n, c in checks.items()])
    return unpivot(means, "field", "share")


def completeness_checks() -> dict[str, Column]:
    c = F.col
    return {
        "province": c("province").isNotNull(),
        "city": c("city").isNotNull(),
        "date_posted": c("date_posted").isNotNull(),
        "valid_through": c("valid_through").isNotNull(),
        "valid_through_reliable": c("valid_through_reliable"),
        "salary_disclosed": c("salary_status") == "DISCLOSED",
        "salary_reliable_monthly_idr": reliable_salary(),
        "description_100_chars": c("description_length") >= limits.DESCRIBED_CHARS,
        "canonical_url": c("canonical_url").isNotNull(),
        "source_identifier": c("source_identifier").isNotNull(),
        "employment_type": c("employment_type") != "UNKNOWN",
        "education": c("education_level") != "UNKNOWN",
    }


def list_frequencies(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("count"))


def missing_values(jobs: DataFrame) -> DataFrame:
    c = F.col
    checks = {
        "company_name": c("company_name").isNull(),
        "city": c("city").isNull(),
        "province": c("province").isNull(),
        "employment_type": c("employment_type") == "UNKNOWN",
        "experience": c("experience_band") == "UNKNOWN",
        "education": c("education_level") == "UNKNOWN",
        "salary": c("salary_status") != "DISCLOSED",
        "description": c("description").isNull(),
        "source_url": c("source_url").isNull(),
        "published_at": c("published_at").isNull(),
    }
    return unpivot(jobs.agg(*[F.count_if(v).alias(k) for k, v in checks.items() if _has(jobs, k)]), "field", "missing")


_COLUMN_OF = {"experience": "experience_band", "education": "education_level", "salary": "salary_status"}


def _has(jobs: DataFrame, check: str) -> bool:
    return _COLUMN_OF.get(check, check) in jobs.columns


def code_counts(jobs: DataFrame, columns=("location_confidence", "salary_status", "normalization_version")) -> DataFrame:
    """(column, key, count) of several code columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in columns])
    return jobs.select(F.explode(cells).alias("c")).groupBy("c.column", "c.key").agg(F.count("*").alias("count"))


def same_source_fingerprints(jobs: DataFrame) -> DataFrame:
    """One row: groups of one source's jobs sharing a fingerprint, and the jobs in them."""
    groups = jobs.groupBy("primary_source_id", "fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(
        F.count("*").alias("same_source_fingerprint_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("jobs_in_fingerprint_groups"),
    )


def inventory(observations: DataFrame, records: DataFrame, vacancies: DataFrame) -> DataFrame:
    """One row of level counts: one aggregate per table, joined as scalars."""
    o = observations.agg(
        F.count("*").alias("observations"),
        F.count_if(F.col("observation_type") == "reobservation").alias("observations_from_unchanged_recaptures"),
        F.count_if("is_valid").alias("valid_observations"),
        F.count_distinct("crawl").alias("crawls_with_data"),
    )
    r = records.agg(
        F.count("*").alias("source_records"),
        F.count_if("is_valid").alias("valid_source_records"),
        F.count_if(~F.col("is_valid")).alias("rejected_source_records"),
    )
    v = vacancies.agg(
        F.count("*").alias("canonical_vacancies"),
        F.count_if(F.col("source_sites") > 1).alias("vacancies_on_multiple_sites"),
        F.count_if("merged_fuzzy").alias("vacancies_with_fuzzy_merge"),
        F.count_if("city_templated").alias("city_templated_campaigns"),
        F.count_if(F.col("valid_through").isNotNull() & ~F.col("valid_through_reliable"))
        .alias("vacancies_with_template_deadline"),
        F.count_if(F.size("crawls") > 1).alias("vacancies_seen_in_multiple_crawls"),
        F.count_distinct("organization_key").alias("distinct_employers"),
        F.count_distinct("source_domain").alias("distinct_sites"),
    )
    out = o.withColumns({"r": r.select(F.struct("*")).scalar(), "v": v.select(F.struct("*")).scalar()})
    out = out.select(*o.columns, "r.*", "v.*")
    rate = F.round(1 - F.col("canonical_vacancies") / F.col("valid_source_records"), 4)
    return out.withColumn(
        "duplicate_rate_records_to_vacancies", F.when(F.col("valid_source_records") > 0, rate)
    )


def time_coverage(vacancies: DataFrame) -> DataFrame:
    expired = F.when(F.col("valid_through_reliable"), (F.col("valid_through") < F.to_date("last_seen_at")).cast("int"))
    return vacancies.agg(
        F.min("first_seen_at").alias("first_capture"), F.max("last_seen_at").alias("last_capture"),
        F.min("date_posted").alias("earliest_date_posted"), F.max("date_posted").alias("latest_date_posted"),
        F.round(F.avg(expired), 4).alias("expired_at_last_capture_share"),
    )


def ordered_levels(levels: DataFrame) -> DataFrame:
    """Reconciliation checks (name, expected, actual, ok) over an ``inventory`` row."""
    c = F.col
    checks = [
        ("observations >= source_records", c("source_records"), c("observations"), c("observations") >= c("source_records")),
        ("source_records >= valid_source_records", c("valid_source_records"), c("source_records"),
         c("source_records") >= c("valid_source_records")),
        ("valid_source_records >= vacancies", c("canonical_vacancies"), c("valid_source_records"),
         c("valid_source_records") >= c("canonical_vacancies")),
        ("valid + rejected = source_records", c("source_records"),
         c("valid_source_records") + c("rejected_source_records"),
         c("valid_source_records") + c("rejected_source_records") == c("source_records")),
    ]
    rows = [
        F.struct(F.lit(n).alias("name"), e.cast("bigint").alias("expected"), a.cast("bigint").alias("actual"), ok.alias("ok"))
        for n, e, a, ok in checks
    ]
    return levels.select(F.explode(F.array(*rows)).alias("k")).select("k.*")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: do two builds hold the same rows, repeated ones as often?

    Rows are compared by count and by the sum of two row hashes. Each column gives its hash and
    whether it is NULL, so equal values in other columns and repeated rows don't cancel out."""

    def digest(df: DataFrame) -> DataFrame:
        parts = [part for c in sorted(df.columns) for part in (F.col(c).isNull(), F.col(c))]
        wide = [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)") for seed in (1, 2)]
        return df.agg(
            F.count("*").alias("n"),
            F.array(*[F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in wide]).alias("x"),
        )

    a, b = digest(left), digest(right)
    out = a.withColumn("o", b.select(F.struct("*")).scalar())
    return out.select(
        F.lit("rebuild identical").alias("name"), F.col("o.n").alias("expected"), F.col("n").alias("actual"),
        ((F.col("n") == F.col("o.n")) & (F.col("x") == F.col("o.x"))).alias("ok"),
    )


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, key) for every row that breaks a rule; a NULL condition is no violation."""
    broken = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def job_constraints(codes: dict[str, dict] | None = None) -> dict[str, Column]:
    rules = {
        "salary_bounds_ordered": F.col("salary_min") <= F.col("salary_max"),
        "salary_amounts_only_when_disclosed": (F.col("salary_status") == "DISCLOSED")
        | (F.col("salary_min").isNull() & F.col("salary_max").isNull()),
    }
    for column, table in (codes or {}).items():
        rules[f"{column}_in_vocabulary"] = F.col(column).isin(*table)
    return rules


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
