"""Quality rules in DataFrame functions only: counting rules, and a hashed n-gram likelihood ratio.

Counting rules: see ``measures``. The ratio compares two multinomials over hashed n-grams: one of a
trusted target (documents labelled good), one of the raw corpus (all documents). The n-grams are one
and two neighbouring word forms; a form is the lower-cased word with every run of four or more
letters written as ``w``, so it keeps short words, digits and signs. Both multinomials are counted
over whole tables. A document's score is the mean over its n-grams of log(target / raw), and a
document is kept if no counting rule fails and the score is at least the threshold, the same for all.

The measures and forms are written once to the shared folder; the counting and the scoring read that
narrow table, so texts are read once and never shuffled.

Null and empty texts have no words: all counts 0, base_failed true (too few words), score 0. Without
trusted documents all weights are 0 and only the counting rules decide. One output row per input
row; columns besides the named ones are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.stage import written

BUCKETS = 8192
SMOOTHING = 1.0
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.25
LEAST_WORDS = 10
WINDOW = 5
BLANKS = r"[ \t-\r]+"


def bound(value: Column, use) -> Column:
    """use(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(words: Column) -> Column:
    """A hash for each run of five words."""
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: equal windows meet when sorted; overlaps count once."""
    places = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_places: Column) -> Column:
        same = F.filter(
            sorted_places,
            lambda x, k: F.coalesce(x["h"] == F.get(sorted_places, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(sorted_places, k + 1)["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def words(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

    return bound(bound(places, repeated), words)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and forms (word forms, blank-separated).

    Words are runs without ASCII white space; word_chars counts code points in words, n_symbols the
    characters ``# * $ % & | < >``, n_dup_lines the lines with a word that equal an earlier line, and
    n_repeat_words the words inside five-word windows that occur at least twice.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), *carry, text.alias("text")).withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    counted = split.select(
        "doc_id", *carry, "text", "words",
        _windows(F.col("words")).alias("windows"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("bigint")).otherwise(_covered(F.col("windows")))
    return counted.select(
        "doc_id", *carry,
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\p{L}{4,}", "w"), BLANKS, " ")).alias("forms"),
    )


def _grams(forms: Column) -> Column:
    """The bucket of every word form and of every two neighbouring ones."""
    def hashed(words: Column) -> Column:
        singles = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
        pairs = F.when(
            F.size(words) >= 2,
            F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                        lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(BUCKETS)).cast("int")),
        ).otherwise(F.array().cast("array<int>"))
        return F.concat(singles, pairs)

    return bound(F.array_remove(F.split(forms, " "), ""), hashed)


def log_ratios(measured: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) for each bucket, from counts over all documents and all trusted ones."""
    good = trusted.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.lit(1).alias("good"))
    marked = measured.select("doc_id", "forms").join(good.hint("merge"), "doc_id", "left")
    counts = (
        marked.select(F.explode(_grams(F.col("forms"))).alias("bucket"), "good")
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
        .collect()  # at most BUCKETS rows
    )
    raw_all = sum(r["raw"] for r in counts) + SMOOTHING * BUCKETS
    target_all = sum(r["target"] for r in counts) + SMOOTHING * BUCKETS
    if not any(r["target"] for r in counts):
        return [0.0] * BUCKETS
    ratios = [math.log(raw_all / target_all)] * BUCKETS
    for r in counts:
        ratios[r["bucket"]] = math.log((r["target"] + SMOOTHING) / target_all) - math.log((r["raw"] + SMOOTHING) / raw_all)
    return [round(x, 9) for x in ratios]


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Measures, base_failed, score and kept for every document; trusted has the doc_id of good documents.

    ``carry`` names further columns of docs that come along.
    """
    measured = written(measures(docs, id_col, text_col, carry), "quality-measures")
    weights = F.from_json(F.lit(json.dumps(log_ratios(measured, trusted))), "array<double>")

    def mean(buckets: Column) -> Column:
        total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))
        return F.when(F.size(buckets) > 0, total / F.size(buckets)).otherwise(F.lit(0.0))

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("score", bound(_grams(F.col("forms")), mean)).select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"), "score",
    )
