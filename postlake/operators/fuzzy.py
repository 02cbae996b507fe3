"""Similarity join on Jaro-Winkler inside blocks by a cheap bound on every pair of a block.

With score t and a common prefix of l <= 4 characters, the plain Jaro score must reach
J = (t - 0.1 l) / (1 - 0.1 l). Jaro is at most (o/n + o/m + 1) / 3 for lengths n, m and o shared
characters (with multiplicity). Every string carries its characters as bits: bit c of the k-th
number is set when bucket c holds at least k of its characters. The bits that two strings share,
and the smaller count of characters beyond the last number, are at least o, so no pair that may
reach t is lost. The test is a few integer operations inside the join; texts are scored only for
the pairs that pass. The join is quadratic in a block's distinct texts: a block is dealt out to
tiles of about ``TILE`` texts by hash, and a task joins two tiles, so its memory does not grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.similarity import jaro_winkler
from postlake.rules import limits

_EPS = 1e-9
#: Numbers of a signature; of characters that a text repeats more often only the count is kept.
LEVELS = 12
#: Distinct texts of a tile, about.
TILE = 2500


def needed_jaro(threshold: float) -> list[float]:
    """Jaro score needed per common-prefix length 0..4."""
    needed = [(threshold - 0.1 * n) / (1 - 0.1 * n) for n in range(5)]
    if needed[-1] <= 0.7:
        raise ValueError("the candidate keys are lossless for thresholds above 0.82 only")
    return needed


def _signed(titles: DataFrame) -> DataFrame:
    """Each text's signature: LEVELS numbers with a bit for each bucket that holds at least 1, 2, ... of its
    characters, the characters beyond, its length and its first four characters."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    bucket = lambda c: F.when(c == " ", 63).otherwise(F.ascii(c) % 39)
    # Staged columns: a lambda would repeat an expression for every character.
    titles = titles.withColumn("_buckets", F.array_sort(F.transform(chars, bucket)))
    titles = titles.withColumn("_levels", F.transform("_buckets", lambda c, i: (i + 1 - F.array_position("_buckets", c)) * 64 + c))

    def bits(k: int) -> Column:
        held = F.filter("_levels", lambda x: (x >= 64 * k) & (x < 64 * (k + 1)))
        return F.aggregate(held, F.lit(0).cast("bigint"), lambda got, x: got.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 64).cast("int"))))

    signed = {
        "_n": F.length("text"), **{f"_s{k}": bits(k) for k in range(LEVELS)},
        "_rest": F.size(F.filter("_levels", lambda x: x >= 64 * LEVELS)),
        **{f"_c{i}": F.ascii(F.substr("text", F.lit(i + 1), F.lit(1))) for i in range(4)},
    }
    # Never NULL: the join's test stays short enough to be compiled.
    return titles.withColumns({name: F.coalesce(value, F.lit(0)) for name, value in signed.items()}).drop("_buckets", "_levels")


def _tiled(titles: DataFrame, block: Sequence[str]) -> DataFrame:
    """Each text with its signature and its tile of the block, of so many (1 for most blocks)."""
    big = titles.groupBy(*block).agg(F.count("*").alias("_size")).filter(F.col("_size") > TILE)
    tiles = F.coalesce(F.ceil(F.col("_size") / TILE), F.lit(1)).cast("int")
    return _signed(titles).join(big, list(block), "left").withColumn("_tiles", tiles).withColumn(
        "_tile", F.pmod(F.xxhash64("text"), F.col("_tiles")).cast("int")).drop("_size")


def candidate_pairs(titles: DataFrame, block: Sequence[str], threshold: float = limits.FUZZY_TITLE) -> DataFrame:
    """Distinct (block, left, right) with left < right that may reach ``threshold``, of distinct titles."""
    needed = needed_jaro(threshold)
    tiled = _tiled(titles, block)
    own = [c for c in tiled.columns if c.startswith("_") and c not in ("_tile", "_tiles")]

    def side(name: str, pair: Column) -> DataFrame:
        return tiled.select(*block, F.explode(pair).alias("_pair"), *[F.col(c).alias(f"{name}{c}") for c in ("text", *own)]).select("*", "_pair.*").drop("_pair")

    def pairs(low: Column, high: Column) -> Column:
        return F.struct(low.alias("_low"), high.alias("_high"))

    tile, last = F.col("_tile"), F.col("_tiles") - 1
    a = side("a", F.transform(F.sequence(tile, last), lambda j: pairs(tile, j)))
    b = side("b", F.transform(F.sequence(F.lit(0), tile), lambda i: pairs(i, tile)))
    differ = lambda i: F.col(f"a_c{i}") != F.col(f"b_c{i}")
    jaro = F.when(differ(0), needed[0]).when(differ(1), needed[1]).when(differ(2), needed[2]).when(differ(3), needed[3]).otherwise(needed[4])
    an, bn = F.col("a_n"), F.col("b_n")
    shared = sum((F.bit_count(F.col(f"a_s{k}").bitwiseAND(F.col(f"b_s{k}"))) for k in range(LEVELS)), F.least("a_rest", "b_rest"))
    reachable = F.least(shared, an, bn).cast("bigint") * (an + bn) >= (3 * jaro - 1 - _EPS) * an * bn
    once = (F.col("_low") < F.col("_high")) | (F.col("atext") < F.col("btext"))
    # Few bytes and much work: the tiles keep all partitions, which adaptive execution would merge.
    keys = [*block, "_low", "_high"]
    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).filter(reachable & once)
    return met.select(*block, F.least("atext", "btext").alias("left"), F.greatest("atext", "btext").alias("right"))


def similar_pairs(
    df: DataFrame, block: Sequence[str], text: str, threshold: float = limits.FUZZY_TITLE,
) -> DataFrame:
    """(block, left, right, score): distinct texts of one block scoring at least ``threshold``."""
    titles = df.select(*block, F.col(text).alias("text")).filter(F.col("text") != "").distinct()
    pairs = candidate_pairs(titles, block, threshold)
    return pairs.withColumn("score", jaro_winkler("left", "right")).filter(F.col("score") >= threshold)


def similar_groups(
    groups: DataFrame, threshold: float = limits.FUZZY_TITLE, window_days: int = limits.SAME_OPENING_DAYS,
) -> DataFrame:
    """(left_group, right_group) of exact groups to merge.

    Titles are compared once per employer and place; then groups of similar titles pair up
    when their first dates lie within the window (campaigns, place '*', always). Dates are
    bucketed so each group meets only neighbours in time.
    """
    block = ["organization_key", "place_key"]
    pairs = similar_pairs(groups, block, "title_key", threshold)
    width = window_days + 1
    bucket = F.when(F.col("place_key") == "*", 0).otherwise(
        F.floor(F.datediff("group_anchor", F.lit("1970-01-01").cast("date")) / width)
    )
    near = F.when(F.col("place_key") == "*", F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array(bucket - 1, bucket, bucket + 1)
    )
    left = groups.select(
        *block, F.col("title_key").alias("left"), F.col("exact_group").alias("left_group"),
        F.col("group_anchor").alias("left_anchor"), F.explode(near).alias("bucket"),
    )
    right = groups.select(
        *block, F.col("title_key").alias("right"), F.col("exact_group").alias("right_group"),
        F.col("group_anchor").alias("right_anchor"), bucket.alias("bucket"),
    )
    close = (F.col("place_key") == "*") | (
        F.abs(F.datediff("left_anchor", "right_anchor")) <= window_days
    )
    return (
        pairs.join(left, [*block, "left"]).join(right, [*block, "right", "bucket"]).filter(close)
        .select("left_group", "right_group")
    )
