"""Source records to canonical vacancies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators.components import connected_components
from postlake.operators.fuzzy import similar_groups
from postlake.operators.openings import exact_groups
from postlake.operators.records import latest_values
from postlake.operators.templates import campaign_groups, flag_members
from postlake.rules import limits
from postlake.session import cut_lineage

LIFETIME = ("first_seen_at", "last_seen_at", "observations", "crawls", "crawls_observed")


def candidates(records: DataFrame) -> DataFrame:
    """Keys of the valid records: employer, title, place ('*' for copied campaigns), date."""
    dash = F.lit("-")
    base = records.filter("is_valid and title_key <> '' and organization_key <> ''").select(
        "source_record_key", "source_domain", "organization_key", "title_key",
        F.coalesce(F.lower("city"), F.lower("province"), F.lit("?")).alias("place_key"),
        F.coalesce("date_posted", F.to_date("first_seen_at")).alias("anchor_date"),
        F.concat_ws("/", F.coalesce(F.col("salary_min").cast("string"), dash),
                    F.coalesce(F.col("salary_max").cast("string"), dash)).alias("salary_key"),
    )
    keys = ["source_domain", "organization_key", "title_key"]
    copied = campaign_groups(base, keys, "place_key", "salary_key")
    return flag_members(base, copied, keys, "templated").withColumn(
        "place_key", F.when(F.col("templated"), "*").otherwise(F.col("place_key"))
    )


def vacancy_members(
    records: DataFrame, gap_days: int = limits.SAME_OPENING_DAYS, threshold: float = limits.FUZZY_TITLE,
) -> DataFrame:
    """(source_record_key, vacancy_group, templated): which records form one vacancy.

    Exact groups are runs of dates per employer, title and place; groups with near-identical
    titles merge transitively.
    """
    keyed = cut_lineage(candidates(records))
    dates = cut_lineage(exact_groups(keyed, gap_days))
    groups = dates.select(
        "organization_key", "title_key", "place_key", "exact_group", "group_anchor"
    ).distinct()
    merged = connected_components(
        similar_groups(groups, threshold, gap_days), "left_group", "right_group"
    )
    labelled = dates.join(merged, dates.exact_group == merged.node, "left").select(
        "organization_key", "title_key", "place_key", "anchor_date",
        F.coalesce("component", "exact_group").alias("vacancy_group"),
    )
    return keyed.join(labelled, ["organization_key", "title_key", "place_key", "anchor_date"]).select(
        "source_record_key", "vacancy_group", "templated"
    )


def collapse_vacancies(records: DataFrame, members: DataFrame, mode: str = "column") -> DataFrame:
    """One row per vacancy group: the earliest non-NULL value of each column, lifetime, sites,
    crawls and merge flags. Every aggregate merges map-side."""
    joined = records.join(members, "source_record_key")
    dropped = {"vacancy_group", "source_record_key", "templated", *LIFETIME}
    values = [c for c in joined.columns if c not in dropped]
    order = F.struct(
        F.coalesce("date_posted", F.to_date("first_seen_at")), F.col("first_seen_at"), F.col("source_record_key")
    )
    kept = joined.groupBy("vacancy_group").agg(
        F.md5(F.min("source_record_key")).alias("vacancy_id"),
        *latest_values(joined, ["vacancy_group"], values, order, mode, latest=False),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.count("*").alias("source_records"),
        F.count_distinct("source_domain").alias("source_sites"),
        F.sum("observations").alias("observations"),
        F.array_sort(F.collect_set("source_domain")).alias("sites"),
        (F.min("title_key") < F.max("title_key")).alias("merged_fuzzy"),
        F.bool_or("templated").alias("city_templated"),
    )
    # Crawl names are few; a set of (group, crawl) pairs stays small per group.
    crawls = joined.select("vacancy_group", F.explode("crawls").alias("crawl")).groupBy("vacancy_group").agg(
        F.array_sort(F.collect_set("crawl")).alias("crawls")
    )
    return kept.join(crawls, "vacancy_group", "left").drop("vacancy_group")


def member_table(members: DataFrame) -> DataFrame:
    """(vacancy_id, source_record_key): the members of every vacancy, one row each."""
    ids = members.groupBy("vacancy_group").agg(F.md5(F.min("source_record_key")).alias("vacancy_id"))
    return members.join(ids, "vacancy_group").select("vacancy_id", "source_record_key")


def with_member_lists(vacancies: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Add the sorted ``member_keys`` array. Convenience for exports of vacancies of ordinary
    size; ``member_table`` is the form that does not build one long array for a hot vacancy."""
    lists = member_rows.groupBy("vacancy_id").agg(
        F.array_sort(F.collect_list("source_record_key")).alias("member_keys")
    )
    return vacancies.join(lists, "vacancy_id", "left")
