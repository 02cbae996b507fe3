"""Detectors of theme defaults and copied campaigns. All are counts of counts: every level
combines map-side, and a site's rows never meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.rules import limits
from postlake.rules.words import REASON_BELOW_FLOOR, REASON_SITE_TEMPLATE


def dominant_value_sites(
    df: DataFrame, site: str, value: Sequence[str], minimum: int = limits.SALARY_TEMPLATE_RECORDS,
    share: float = limits.SALARY_TEMPLATE_SHARE,
) -> DataFrame:
    """Sites whose most common value covers ``share`` of at least ``minimum`` rows."""
    pairs = df.groupBy(site, *value).agg(F.count("*").alias("n"))
    return (
        pairs.groupBy(site).agg(F.sum("n").alias("disclosed"), F.max("n").alias("top"))
        .withColumn("top_share", F.col("top") / F.col("disclosed"))
        .filter((F.col("disclosed") >= minimum) & (F.col("top_share") >= share))
        .select(site, "disclosed", "top_share")
    )


def dominant_date_sites(
    df: DataFrame, site: str, date: str, start: str, minimum: int = limits.DEADLINE_TEMPLATE_RECORDS,
    share: float = limits.DEADLINE_TEMPLATE_SHARE,
) -> DataFrame:
    """Sites where one date, or one number of days after ``start``, covers ``share`` of the rows."""
    dated = df.filter(F.col(date).isNotNull()).select(
        site, F.col(date).alias("d"), F.datediff(date, start).alias("o")
    )
    # One aggregate carries both candidates: (site, date, offset) -> the two value counts.
    cells = dated.groupBy(site, "d", "o").agg(F.count("*").alias("n"))
    values = cells.select(
        site, "n",
        F.explode(
            F.array(
                F.struct(F.lit("date").alias("kind"), F.datediff("d", F.lit("1970-01-01").cast("date")).alias("x")),
                F.struct(F.lit("offset").alias("kind"), F.col("o").alias("x")),
            )
        ).alias("e"),
    ).select(site, "n", "e.*")
    counted = values.groupBy(site, "kind", "x").agg(F.sum("n").alias("n"))
    tops = counted.groupBy(site).agg(
        F.sum(F.when(F.col("kind") == "date", F.col("n"))).alias("deadlines"),
        F.max(F.when(F.col("x").isNotNull(), F.col("n"))).alias("top"),
    )
    return (
        tops.withColumn("top_share", F.col("top") / F.col("deadlines"))
        .filter((F.col("deadlines") >= minimum) & (F.col("top_share") >= share))
        .select(site, "deadlines", "top_share")
    )


def campaign_groups(
    df: DataFrame, group: Sequence[str], place: str, value: str, places: int = limits.CAMPAIGN_PLACES,
    share: float = limits.CAMPAIGN_SALARY_SHARE,
) -> DataFrame:
    """Groups seen in at least ``places`` places where one value covers ``share`` of the rows."""
    cells = df.groupBy(*group, value, place).agg(F.count("*").alias("n"))
    by_value = cells.groupBy(*group, value).agg(F.sum("n").alias("n"))
    shares = by_value.groupBy(*group).agg((F.max("n") / F.sum("n")).alias("top_share"))
    spread = cells.groupBy(*group).agg(F.count_distinct(place).alias("places"))
    return (
        shares.join(spread, list(group))
        .filter((F.col("places") >= places) & (F.col("top_share") >= share))
        .select(*group, "places", "top_share")
    )


def flag_members(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add a boolean: is the row's key among ``members``? NULL keys are never members.

    The member side is small in practice but not by proof, so the join carries no hint:
    adaptive execution broadcasts it on its measured size and splits hot keys otherwise.
    """
    marked = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mark_salary_templates(records: DataFrame, floor: int = limits.PAY_FLOOR) -> DataFrame:
    """Add salary_template_site, salary_unreliable_reason and salary_reliable."""
    paid = records.filter(F.col("is_valid") & F.col("salary_monthly_min").isNotNull())
    sites = dominant_value_sites(paid, "source_domain", ["salary_monthly_min", "salary_monthly_max"])
    out = flag_members(records, sites, ["source_domain"], "salary_template_site")
    middle = (F.col("salary_monthly_min") + F.col("salary_monthly_max")) / 2
    reason: Column = (
        F.when(F.col("salary_monthly_min").isNull(), None)
        .when(F.col("salary_template_site"), REASON_SITE_TEMPLATE)
        .when(middle < floor, REASON_BELOW_FLOOR)
    )
    return out.withColumn("salary_unreliable_reason", reason.cast("string")).withColumn(
        "salary_reliable", F.col("salary_monthly_min").isNotNull() & F.col("salary_unreliable_reason").isNull()
    )


def mark_deadline_templates(records: DataFrame) -> DataFrame:
    """Add deadline_template_site and valid_through_reliable."""
    sites = dominant_date_sites(records.filter("is_valid"), "source_domain", "valid_through", "date_posted")
    out = flag_members(records, sites, ["source_domain"], "deadline_template_site")
    return out.withColumn(
        "valid_through_reliable", F.col("valid_through").isNotNull() & ~F.col("deadline_template_site")
    )
