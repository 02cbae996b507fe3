"""Openings: runs of dates per key in which consecutive dates are at most N days apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.rules import limits


def date_runs(
    df: DataFrame, keys: Sequence[str], date: str, gap_days: int = limits.SAME_OPENING_DAYS,
    never_split: Column | None = None,
) -> DataFrame:
    """(keys, date, rows, run): the run number of every distinct date of a key.

    Rows are reduced to distinct dates first, so the window of even the hottest key holds at
    most one row per calendar day. A gap of exactly ``gap_days`` does not split.
    """
    days = df.groupBy(*keys, date).agg(F.count("*").alias("rows"))
    order = Window.partitionBy(*keys).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(order))
    splits = gap > gap_days if never_split is None else (gap > gap_days) & ~never_split
    starts = F.when(gap.isNull() | splits, 1).otherwise(0)
    return days.withColumn("_start", starts).withColumn(
        "run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_start")


def gaps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """(keys, date, rows, gap): days since the key's previous distinct date."""
    days = df.groupBy(*keys, date).agg(F.count("*").alias("rows"))
    order = Window.partitionBy(*keys).orderBy(date)
    return days.withColumn("gap", F.datediff(F.col(date), F.lag(date).over(order)))


def exact_groups(candidates: DataFrame, gap_days: int = limits.SAME_OPENING_DAYS) -> DataFrame:
    """(employer, title, place, date) -> exact_group and its first date.

    ``candidates`` needs organization_key, title_key, place_key and anchor_date; the place
    '*' (a campaign) is never split.
    """
    keys = ["organization_key", "title_key", "place_key"]
    runs = date_runs(candidates, keys, "anchor_date", gap_days, F.col("place_key") == "*")
    first = Window.partitionBy(*keys, "run")
    return runs.select(
        *keys, "anchor_date",
        F.concat_ws("|", *keys, F.col("run").cast("string")).alias("exact_group"),
        F.min("anchor_date").over(first).alias("group_anchor"),
    )
