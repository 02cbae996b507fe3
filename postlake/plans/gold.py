"""Gold tables over vacancies, and the one-row reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators.pay_rule import monthly_midpoint, reliable_salary
from postlake.operators.percentiles import grouped_percentiles
from postlake.operators.salary_stats import grouped_salary
from postlake.rules import limits
from postlake.rules.words import UNKNOWN_PLACES


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("vacancies"))


def by_province(v: DataFrame) -> DataFrame:
    """Multi-place vacancies count in each province; campaigns and unknown places in one bucket."""
    nowhere = F.col("city_templated") | (F.size("provinces") == 0)
    places = F.when(nowhere, F.array(F.lit(UNKNOWN_PLACES))).otherwise(F.array_distinct("provinces"))
    return count_by(v.select(F.explode(places).alias("province")), "province")


def by_city(v: DataFrame) -> DataFrame:
    return count_by(v.filter(F.col("city").isNotNull() & ~F.col("city_templated")), "province", "city")


def by_experience(v: DataFrame) -> DataFrame:
    years = F.col("experience_min_years")
    bucket = (
        F.when(years.isNull(), "UNKNOWN").when(years < 1, "<1").when(years < 3, "1-2").when(years < 5, "3-4")
        .when(years < 10, "5-9").otherwise("10+")
    )
    return count_by(v.select(bucket.alias("min_years")), "min_years")


def employers(v: DataFrame) -> DataFrame:
    return v.groupBy("organization_key").agg(
        F.min("organization").alias("organization"), F.count("*").alias("vacancies"),
        F.count_distinct("source_domain").alias("sites"),
    )


def salary_overall(v: DataFrame) -> DataFrame:
    ok = reliable_salary()
    names = [f"p{round(p * 100)}" for p in limits.PERCENTILES]
    counts = v.agg(
        F.count("*").alias("vacancies"), F.count_if(F.col("salary_status") == "DISCLOSED").alias("disclosed"),
        F.count("salary_monthly_min").alias("disclosed_monthly_idr"),
        F.count_if("salary_template_site").alias("on_salary_template_sites"), F.count_if(ok).alias("n"),
    )
    q = grouped_percentiles(v.filter(ok), [], monthly_midpoint(), limits.PERCENTILES, names)
    out = counts.withColumn("q", q.select(F.struct(*names)).scalar())
    return out.select(*counts.columns, F.array(*[F.col(f"q.{n}") for n in names]).alias("percentiles"))


def salary_by(v: DataFrame, dimension: str) -> DataFrame:
    return grouped_salary(v, dimension, reliable_salary(), total="vacancies")


def capped_histogram(df: DataFrame, value, width: float, last: int) -> DataFrame:
    """(lower_bound, count): equal bins, everything from the last bound on in one bin."""
    return df.groupBy((F.least(F.floor(value / width), F.lit(last)) * width).alias("lower_bound")).agg(
        F.count("*").alias("vacancies")
    )


def salary_histogram(v: DataFrame) -> DataFrame:
    return capped_histogram(v.filter(reliable_salary()), monthly_midpoint(), limits.GOLD_BIN_WIDTH, limits.GOLD_LAST_BIN)


def list_shares(df: DataFrame, column: str, name: str, group: str | None = None, having: int = 1) -> DataFrame:
    """Frequency of list items with the share of the (group's) rows as denominator."""
    keys = [group] if group else []
    items = df.select(*keys, F.explode(column).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("vacancies"))
    items = items.filter(F.col("vacancies") >= having)
    if group:
        totals = df.groupBy(group).agg(F.count("*").alias("denominator"))
        items = items.join(totals, group)
    else:
        items = items.withColumn("denominator", df.agg(F.count("*")).scalar())
    return items.withColumn("share", F.col("vacancies") / F.col("denominator"))


def described(v: DataFrame) -> DataFrame:
    return v.filter(F.col("description_length") >= limits.DESCRIBED_CHARS)


def postings_by_month(v: DataFrame, date: str = "date_posted") -> DataFrame:
    return v.filter(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("month")).agg(
        F.count("*").alias("vacancies")
    )


def observation_lag(v: DataFrame, posted: str = "date_posted", seen: str = "first_seen_at") -> DataFrame:
    lag = F.datediff(F.to_date(seen), posted)
    bucket = (
        F.when(F.col(posted).isNull(), "unknown").when(lag <= 7, "0-7 days").when(lag <= 30, "8-30 days")
        .when(lag <= 90, "31-90 days").when(lag <= 365, "91-365 days").otherwise(">1 year")
    )
    return count_by(v.select(bucket.alias("posted_before_first_capture")), "posted_before_first_capture")


def site_table(v: DataFrame) -> DataFrame:
    return v.groupBy("source_domain", "site_type").agg(
        F.count("*").alias("vacancies"), (F.count_if("salary_template_site") > 0).alias("salary_template_site")
    )


TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "vacancies_by_province": by_province,
    "vacancies_by_city": by_city,
    "vacancies_by_role_family": lambda v: count_by(v, "role_family"),
    "vacancies_by_employment_type": lambda v: count_by(v, "employment_type"),
    "vacancies_by_education": lambda v: count_by(v, "education_level"),
    "vacancies_by_experience": by_experience,
    "vacancies_by_work_arrangement": lambda v: count_by(v, "work_arrangement"),
    "employers": employers,
    "salary_overall": salary_overall,
    "salary_by_role_family": lambda v: salary_by(v, "role_family"),
    "salary_by_province": lambda v: salary_by(v, "province"),
    "salary_histogram": salary_histogram,
    "skills_overall": lambda v: list_shares(described(v), "skills", "skill"),
    "skills_by_role_family": lambda v: list_shares(described(v), "skills", "skill", "role_family", having=3),
    "postings_by_month": postings_by_month,
    "observation_lag": observation_lag,
    "sites": site_table,
}


def crawl_yield(v: DataFrame, key: str = "vacancy_id", crawls: str = "crawls") -> DataFrame:
    """Per crawl: vacancies in it, and those no newer crawl has. The newest crawl of a vacancy
    is the maximum of its own list, so no second pass over the memberships is needed."""
    rows = v.select(F.explode(crawls).alias("crawl"), F.array_max(crawls).alias("newest"))
    return rows.groupBy("crawl").agg(
        F.count("*").alias("vacancies"), F.count_if(F.col("newest") == F.col("crawl")).alias("not_in_newer_crawls")
    )


def write_gold(v: DataFrame, root: str) -> None:
    from postlake.sources.lake import write_parquet

    for name, build in TABLES.items():
        write_parquet(build(v), f"{root}/{name}.parquet")
