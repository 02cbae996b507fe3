"""Classifier evaluation, reviewer agreement, partition agreement: all from contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.rules.vocab import ROLE_FAMILY


def final_label() -> Column:
    """The reviewers' label when they agree, otherwise the adjudicated one."""
    agreed = F.col("reviewer_a") == F.col("reviewer_b")
    return F.when(agreed, F.col("reviewer_a")).otherwise(F.nullif(F.col("adjudicated"), F.lit("")))


def label_problems(labels: DataFrame, codes=ROLE_FAMILY) -> DataFrame:
    """(title, problem): unknown codes, missing reviews, disagreement without adjudication."""
    c = F.col

    def unknown(name: str) -> Column:
        return F.coalesce((c(name) != "") & ~c(name).isin(*codes), F.lit(False))

    missing = F.coalesce(c("reviewer_a"), F.lit("")).eqNullSafe("") | F.coalesce(c("reviewer_b"), F.lit("")).eqNullSafe("")
    problem = (
        F.when(unknown("reviewer_a"), "unknown family in reviewer_a")
        .when(unknown("reviewer_b"), "unknown family in reviewer_b")
        .when(unknown("adjudicated"), "unknown family in adjudicated")
        .when(missing, "both reviewers must label every title")
        .when(final_label().isNull(), "no adjudicated label")
    )
    return labels.select("title", problem.alias("problem")).filter(F.col("problem").isNotNull())


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n): everything below needs only this small table."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def scores(matrix: DataFrame, other: str = "OTHER") -> DataFrame:
    """One row: titles, coverage, precision, recall, accuracy. ``other`` is the unnamed class."""
    hit = F.col("label") == F.col("predicted")
    named_p, named_l = F.col("predicted") != other, F.col("label") != other

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(total(a), total(b)), F.lit(0.0))

    every = F.lit(True)
    return matrix.agg(
        total(every).alias("titles"), ratio(named_p, every).alias("coverage"),
        ratio(named_p & hit, named_p).alias("precision"), ratio(named_l & hit, named_l).alias("recall"),
        ratio(hit, every).alias("accuracy"),
    )


def family_scores(matrix: DataFrame) -> DataFrame:
    """(family, support, predicted, correct, precision, recall)."""
    long = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("family"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("correct")),
                F.struct(F.col("predicted").alias("family"), F.lit(0).cast("bigint").alias("support"),
                         F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("correct")),
            )
        ).alias("f")
    ).select("f.*")
    out = long.groupBy("family").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")])
    return out.withColumns(
        {
            "precision": F.try_divide("correct", "predicted"),
            "recall": F.try_divide("correct", "support"),
        }
    )


def cohen_kappa(matrix: DataFrame, a: str = "label", b: str = "predicted") -> DataFrame:
    """One row (agreement, kappa) of two raters from their contingency counts."""
    n = F.sum("n").cast("double")
    seen = matrix.agg(n.alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = matrix.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x"))
    right = matrix.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("e"))
    out = seen.withColumn("e", F.coalesce(chance.scalar(), F.lit(0.0)) / (F.col("n") * F.col("n")))
    agreement = F.col("same") / F.col("n")
    kappa = F.when(F.col("e") < 1, F.try_divide(agreement - F.col("e"), 1 - F.col("e"))).otherwise(1.0)
    return out.select(agreement.alias("agreement"), kappa.alias("kappa"))


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari, nmi): adjusted Rand index and normalized mutual information (arithmetic
    mean) of two labelings, closed-form over their contingency table."""
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(
        F.count("*").cast("double").alias("n")
    )
    rows = cells.groupBy("a").agg(F.sum("n").alias("x"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("y"))

    def pairs(c: str) -> Column:
        return F.sum(F.col(c) * (F.col(c) - 1) / 2)

    def plogp(c: str) -> Column:
        return F.sum(F.col(c) * F.log(F.col(c)))

    cell = cells.agg(F.sum("n").alias("n"), pairs("n").alias("cell"), plogp("n").alias("hc"))
    out = cell.withColumns(
        {
            "r": rows.agg(F.struct(pairs("x").alias("p"), plogp("x").alias("h"))).scalar(),
            "c": cols.agg(F.struct(pairs("y").alias("p"), plogp("y").alias("h"))).scalar(),
        }
    )
    n = F.col("n")
    expected = F.col("r.p") * F.col("c.p") / (n * (n - 1) / 2)
    highest = (F.col("r.p") + F.col("c.p")) / 2
    ari = F.when(F.abs(highest - expected) < 1e-12, 1.0).otherwise(
        F.try_divide(F.col("cell") - expected, highest - expected)
    )
    log_n = F.log(n)
    h_a, h_b = log_n - F.col("r.h") / n, log_n - F.col("c.h") / n
    mutual = F.greatest(log_n + (F.col("hc") - F.col("r.h") - F.col("c.h")) / n, F.lit(0.0))
    nmi = F.when((h_a + h_b) < 1e-12, 1.0).otherwise(F.try_divide(mutual, (h_a + h_b) / 2))
    return out.select(ari.alias("ari"), nmi.alias("nmi"))
