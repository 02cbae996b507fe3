"""The pipeline's stages on the smallest given tables, each against a plain version over its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from postlake.llm import decontamination, ngram_jaccard, quality_rules
from postlake.llm.queries import piece_model
from postlake.llm.stage import table, written

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_stages(spark):
    from sentencepiece import SentencePieceProcessor

    docs = table(spark, FOLDER, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], FOLDER), f"test-{name.replace(' ', '-')}"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    quality = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    for r in rows[1].values():  # counting rules hold for all that stay
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert len(w) >= 10 and 100 * len(inside) <= 20 * len(w)
    labelled = [d for d in rows[0] if d in quality]
    assert sum((d in rows[2]) == bool(quality[d]) for d in labelled) >= 0.9 * len(labelled)
    sets = {d: shingles(r.text) for d, r in rows[2].items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(rows[3]) == {d for d in sets if root(d) == d}
    items = [decontamination.plain(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    exact = {d for d, r in rows[3].items() if any(i in decontamination.plain(r.text) for i in items)}
    assert not exact & set(rows[4]) and len(rows[3]) - len(rows[4]) <= len(exact) + 2
    library = SentencePieceProcessor(model_file=piece_model())
    assert {d: r.n_tokens for d, r in rows[5].items()} == {d: len(library.encode(r.text)) + 2 for d, r in rows[4].items()}


def test_stages_tell_rows_by_their_texts(spark):
    """Null, repeated and clashing ids, null texts, further columns: each row has the fate of its own text."""
    given, step = table(spark, FOLDER, "documents"), table(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = written(stage(spark, step, FOLDER), f"plain-{name.replace(' ', '-')}")
    alone = ngram_jaccard.near_duplicates(given).groupBy("component_id").agg(F.count("*").alias("n")).filter("n = 1")
    trusted = table(spark, FOLDER, "labels").filter("quality = 1").select("doc_id")
    rated = quality_rules.quality_rules(given, trusted).select("doc_id", "score")  # the best ones without a label, as odd ids have none
    rated = rated.join(table(spark, FOLDER, "labels"), "doc_id", "left_anti")
    chosen = [r.doc_id for r in step.join(alone, F.col("doc_id") == F.col("component_id")).join(rated, "doc_id").orderBy(F.desc("score")).limit(3).collect()]
    good = [given.filter(F.col("doc_id") == d).first().text for d in chosen]
    rows = [(None, good[0], 1), (10**6, good[1], 2), (10**6, "too short", 3), (10**6, good[1], 4), (7, None, 5), (None, "", 6),
            (10**6 + 1, good[0] + " x", 7), (None, good[2], 8), (None, good[2], 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, key int")
    docs = given.filter(~F.col("doc_id").isin(chosen)).select("doc_id", "text", F.lit(0).alias("key")).unionByName(odd)
    docs = docs.selectExpr("*", "'n' as n", "1 as class", "2 as kept", "3 as component").repartition(4)
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = written(stage(spark, step, FOLDER), f"odd-{name.replace(' ', '-')}")
        assert step.columns == docs.columns
        if name == "quality classifier":
            assert sorted(r.key for r in step.filter("key > 0").collect()) == [1, 2, 4, 7, 8, 9]
    # The near copy with an id stands for the text with a null id; of a text with null ids only, its rows stay.
    assert sorted(r.key for r in step.filter("key > 0").collect()) == [2, 4, 7, 8, 9]
    assert corpus_pipeline.STAGES[-1][1](spark, step, FOLDER).count() == step.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
