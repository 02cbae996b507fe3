"""Exact grouped percentiles that never gather a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, which fails when
one group holds a large share of the rows. Here a mergeable sketch brackets each quantile. The
ends of all brackets cut a group's values into segments; a row is looked at once, whatever the
number of quantiles. Segments between brackets are reduced to a count with their least and
largest value, and only the few values inside brackets are ranked exactly. The sketch's error
bound keeps every wanted rank inside its bracket; a rank outside is an error, never a NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.session import cut_lineage

ACCURACY = 10_000
MARGIN = 4  # sketch errors on each side of a bracket
BROADCAST_GROUPS = 10_000  # a group's sketch is its keys and two doubles per probability


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: Column | str, probs: Sequence[float],
    names: Sequence[str] | None = None, accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key group (NULL keys are groups): keys, one double per probability.

    Continuous interpolation, rank ``p * (n - 1)``; rows with a NULL value are ignored.
    """
    names = list(names or [f"p{round(p * 100)}" for p in probs])
    value = F.col(value) if isinstance(value, str) else value
    base = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], value.cast("double").alias("v"))
    base = base.filter(F.col("v").isNotNull())
    ks = [f"k{i}" for i in range(len(keys))]
    edge = MARGIN / accuracy
    brackets = [(max(p - edge, 0.0), min(p + edge, 1.0)) for p in probs]
    cuts = sorted({e for bracket in brackets for e in bracket})
    sketch = base.groupBy(*ks).agg(F.count("*").alias("n"), F.percentile_approx("v", cuts, accuracy).alias("ends"))
    placed = _attach(base, sketch, ks)
    # Segment j holds the values behind end j - 1 up to end j, that end included.
    segment = reduce(lambda a, b: a + b, [(F.col("v") > F.get("ends", F.lit(j))).cast("int") for j in range(len(cuts))])
    inside = [j for j in range(1, len(cuts)) if any(low <= cuts[j - 1] and cuts[j] <= high for low, high in brackets)]
    ranked_value = F.col("seg").isin(inside) | (F.col("v") == F.get("ends", F.col("seg")))
    counts = placed.withColumn("seg", segment).groupBy(*ks, "seg", F.when(ranked_value, F.col("v")).alias("x")).agg(
        F.first("n").alias("n"), F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("top")
    )
    order = Window.partitionBy(*ks).orderBy("seg", F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order))
    first, last = F.col("upto") - F.col("c"), F.col("upto") - 1

    def value_at(r: Column) -> Column:
        known = F.when((F.col("low") == F.col("top")) | (r == first), F.col("low")).when(r == last, F.col("top"))
        missed = F.raise_error(F.lit("a rank lies outside its bracket: ask for a higher accuracy")).cast("double")
        return F.max(F.when((r >= first) & (r <= last), F.coalesce(known, missed)))

    parts = {}
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("n") - 1)
        lower = F.floor(rank + F.lit(1e-9))
        parts |= {
            f"a{i}": value_at(lower), f"b{i}": value_at(F.least(lower + 1, F.col("n") - 1)),
            f"part{i}": F.first(F.greatest(rank - lower, F.lit(0.0))),
        }
    found = ranked.groupBy(*ks).agg(*[c.alias(name) for name, c in parts.items()])
    return found.select(
        *[F.col(k).alias(orig) for k, orig in zip(ks, keys)],
        *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"part{i}")).alias(name) for i, name in enumerate(names)],
    )


def _attach(base: DataFrame, sketch: DataFrame, ks: list[str]) -> DataFrame:
    """Sketch columns on every row. The sketch is computed first and its groups are counted: few are
    broadcast, so that the rows are neither shuffled nor sorted by group; more meet in a shuffled join,
    of which adaptive execution splits hot groups."""
    if not ks:
        return base.withColumns(
            {"n": sketch.select("n").scalar(), "ends": sketch.select("ends").scalar()}
        )
    other = cut_lineage(sketch.select(*[F.col(k).alias(f"s_{k}") for k in ks], "n", "ends"))
    if other.count() <= BROADCAST_GROUPS:
        other = F.broadcast(other)
    condition = F.lit(True)
    for k in ks:
        condition = condition & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    return base.join(other, condition).drop(*[f"s_{k}" for k in ks])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two per-group frames on keys that may be NULL; keeps one copy of the keys."""
    other = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(other, condition, how).drop(*[f"r_{k}" for k in keys])
