"""Title clustering with MLlib: two vectorizations, a k/seed sweep, and its measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.breakdown import top_per_group
from postlake.operators.evaluation import partition_agreement
from postlake.rules import limits
from postlake.rules.words import CLUSTER_STOPWORDS_LETTERS, CLUSTER_STOPWORDS_TOKENS

FEATURES = 1024
K_VALUES = (3, 4, 5, 6, 8, 10, 15)
SEEDS = (42, 1, 7, 123, 2024)


def letters_only(title: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.col(title)), r"[^a-z\s]", " "))


def vectorizer(kind: str, features: int = FEATURES) -> Pipeline:
    """'letters': the original preprocessing. 'tokens': separators never give empty tokens,
    '+' and '#' stay in words, vectors have unit length. Input column ``clean``."""
    english = StopWordsRemover.loadDefaultStopWords("english")
    if kind == "letters":
        stages = [
            Tokenizer(inputCol="clean", outputCol="words"),
            StopWordsRemover(inputCol="words", outputCol="kept", stopWords=english + list(CLUSTER_STOPWORDS_LETTERS)),
            HashingTF(inputCol="kept", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features", minDocFreq=3),
        ]
    elif kind == "tokens":
        stages = [
            RegexTokenizer(inputCol="clean", outputCol="words", pattern="[^a-z0-9+#]+", minTokenLength=1),
            StopWordsRemover(inputCol="words", outputCol="kept", stopWords=english + list(CLUSTER_STOPWORDS_TOKENS)),
            HashingTF(inputCol="kept", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2),
            Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
        ]
    else:
        raise ValueError(f"unknown vectorizer {kind!r}")
    return Pipeline(stages=stages)


def title_vectors(df: DataFrame, title: str, kind: str, single_partition: bool = False, features: int = FEATURES) -> DataFrame:
    """Adds ``features``. ``single_partition`` only reproduces small published runs, because
    k-means|| depends on the partition layout."""
    clean = letters_only(title) if kind == "letters" else F.lower(F.col(title))
    data = df.withColumn("clean", clean)
    if single_partition:
        data = data.coalesce(1)
    return vectorizer(kind, features).fit(data).transform(data)


def empty_token_rows(df: DataFrame, title: str) -> DataFrame:
    """One row: titles whose letters-only form yields an empty token."""
    words = Tokenizer(inputCol="clean", outputCol="words").transform(df.withColumn("clean", letters_only(title)))
    return words.agg(F.count_if(F.array_contains("words", "")).alias("rows"))


def cluster(vectors: DataFrame, k: int, seed: int, max_iter: int = 50) -> DataFrame:
    model = KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed, maxIter=max_iter).fit(vectors)
    return model.transform(vectors)


def sweep(
    vectors: DataFrame, key: str, ks: Sequence[int] = K_VALUES, seeds: Sequence[int] = SEEDS, reference: str | None = None,
) -> DataFrame:
    """(k, seed, silhouette_sq, silhouette_cosine, largest_share, smallest, nmi) per fit, plus the
    pairwise seed stability (ari_mean, ari_min) per k. Fits loop on the driver; rows do not."""
    spark = vectors.sparkSession
    vectors = vectors.cache()
    squared = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
    cosine = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette", distanceMeasure="cosine")
    lines = []
    for k in ks:
        fits = {}
        for seed in seeds:
            predicted = cluster(vectors, k, seed).select(key, "features", "cluster", *([reference] if reference else [])).cache()
            sizes = predicted.groupBy("cluster").count().agg(F.sum("count"), F.max("count"), F.min("count")).first()
            nmi = partition_agreement(predicted, reference, "cluster").first()["nmi"] if reference else None
            lines.append((k, seed, squared.evaluate(predicted), cosine.evaluate(predicted), sizes[1] / sizes[0], sizes[2], nmi))
            fits[seed] = predicted
        both = [
            partition_agreement(
                fits[a].select(key, F.col("cluster").alias("x")).join(fits[b].select(key, F.col("cluster").alias("y")), key), "x", "y"
            ).first()["ari"]
            for a, b in combinations(seeds, 2)
        ]
        lines = [(*line, *((_mean(both), min(both)) if both else (None, None))) if line[0] == k else line for line in lines]
        for frame in fits.values():
            frame.unpersist()
    return spark.createDataFrame(
        lines,
        "k int, seed int, silhouette_sq double, silhouette_cosine double, largest_share double, smallest bigint, "
        "nmi double, ari_mean double, ari_min double",
    )


def _mean(values: list[float]) -> float:
    return reduce(float.__add__, values, 0.0) / len(values)


def best_fit(measures: DataFrame, score: str = "silhouette_sq", minimum: int = limits.MIN_CLUSTER) -> DataFrame:
    """The fit with the best score among those whose clusters all have ``minimum`` members,
    or the best overall when there is none. ``measures`` has one row per fit."""
    return measures.orderBy(F.desc(F.col("smallest") >= minimum), F.desc(score), "k", "seed").limit(1)


def top_titles(predicted: DataFrame, title: str, k: int = 5, cluster_col: str = "cluster") -> DataFrame:
    """The most frequent titles of every cluster."""
    counts = predicted.groupBy(cluster_col, title).agg(F.count("*").alias("count"))
    return top_per_group(counts, [cluster_col], [F.desc("count"), F.asc(title)], k)
