"""The corpus pipeline: quality rules, quality classifier, near-copies, benchmark leaks, token ids.

Each stage takes (spark, docs, folder), works on all rows that the stage before kept, and returns a
DataFrame; ``run`` writes each stage's result as Parquet in the shared folder and reads it again as
the next stage's documents. All stages but the last return the columns of documents.

A stage's verdict is one on a row's text, so rows are told by a hash of their text, not by their id: a
null id is a document like others, a repeated id keeps or loses each of its rows by that row's own text,
and repeated rows share their fate (of near copies all rows of the least id with its text stay). Null
texts count as empty ones, which the rules reject. Further columns, whatever their names, come along.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import decontamination, ngram_jaccard, quality_classifier, quality_rules, sentencepieces
from postlake.llm.queries import piece_model
from postlake.llm.stage import table, written


#: A column for the hash of a row's text while a stage works.
KEY = "_text_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _texts(keyed: DataFrame) -> DataFrame:
    """The texts with their keys as ids."""
    return keyed.select(F.col(KEY).alias("doc_id"), "text")


def _only(keyed: DataFrame, keep: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose text is one of keep's (or none of them)."""
    return keyed.join(keep.select(KEY).distinct(), KEY, how).drop(KEY)


def rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the counting rules and are likely enough under the trusted target."""
    trusted, keyed = table(spark, folder, "labels").filter("quality = 1").select("doc_id"), _keyed(docs)
    return _only(keyed, quality_rules.quality_rules(keyed, trusted, carry=(KEY,)).filter("kept")).select(docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from all documents, also those the rules rejected."""
    model, keyed = quality_classifier.fit(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality"), _keyed(docs)
    scored = quality_classifier.score(_texts(keyed), model).filter("predicted = 1")
    return _only(keyed, scored.withColumnRenamed("doc_id", KEY)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return ngram_jaccard.one_of_each(docs).select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    hits = decontamination.contaminated(_texts(keyed), table(spark, folder, "benchmark")).withColumnRenamed("doc_id", KEY)
    return _only(keyed, hits, "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Numbers and digests of the token ids of each document."""
    return sentencepieces.encode_documents(docs, piece_model())


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near copies", near_copies),
    ("benchmark leaks", leaks),
    ("token ids", token_ids),
]

#: SQL can express neither the hashed ratio, the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), f"stage-{name.replace(' ', '-')}")
    return docs
