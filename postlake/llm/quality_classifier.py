"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear SVM.

Features are hashed indicators: lower-cased words, and one to three neighbouring word shapes (runs of
small letters, capitals and digits written as one sign each, other signs kept; a word equal to the
one before it has a shape of its own). For every feature the documents of either class that hold it
are counted over all training documents; each task adds up its own counts first. An indicator is
scaled by the log ratio of its smoothed class shares, each document's vector is brought to length 1,
and a linear model with hinge loss is fitted by dual coordinate descent. The descent runs on a
bounded sample of training rows (``SAMPLE_ROWS``, chosen by a hash of the id, the same on every run).

Null and empty texts have no features: their score is that of the bias alone. Labels that are null
are ignored; without both classes every score is 0.5. Repeated rows are scored like any other, and
count as often as they occur. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.tokens import blocks, grams, mix, word_bounds, word_hashes

FEATURES = 1 << 17
SAMPLE_ROWS = 4000
SMOOTHING = 1.0
LEAST_SUPPORT = 3
COST = 1.0
EPOCHS = 12
FOLDS, HELD_OUT = 3, 1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_RUNS = np.zeros(256, dtype=bool)
_RUNS[[ord("a"), ord("A"), ord("9")]] = True
_REPEAT = np.uint64(0x5EED)


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def block_features(data: np.ndarray, starts: np.ndarray, size: int = FEATURES) -> Iterator[np.ndarray]:
    """The distinct feature ids of every row of a block."""
    words, rows = word_hashes(data, starts, lower=True)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
        begin, _, _ = word_bounds(data, starts)
        keep[begin] = True
    shapes, _ = word_hashes(shape[keep], np.concatenate([[0], np.cumsum(keep)])[starts])
    if len(words):
        repeated = np.flatnonzero(words[1:] == words[:-1]) + 1
        shapes[repeated[~np.isin(repeated, rows)]] = _REPEAT
    parts = [((mix(words, 11) % np.uint64(size)).astype(np.int32), rows)]
    for n in (1, 2, 3):
        value, at = grams(shapes, rows, n)
        parts.append(((value % np.uint64(size)).astype(np.int32), at))
    for r in range(len(starts) - 1):
        ids = np.sort(np.concatenate([v[at[r] : at[r + 1]] for v, at in parts]))
        yield ids[np.concatenate([[True], ids[1:] != ids[:-1]])] if len(ids) else ids


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and class of one task."""
    counts = np.zeros((2, FEATURES), np.int64)
    documents = np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, data, starts in blocks(batch.column(0)):
            for r, ids in enumerate(block_features(data, starts)):
                counts[label[first + r], ids] += 1
                documents[label[first + r]] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(seen, -1)), pa.array(np.append(counts[0, seen], documents[0])), pa.array(np.append(counts[1, seen], documents[1]))],
        ["feature", "low", "high"],
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [i.tolist() for _, _, data, starts in blocks(batch.column(1)) for i in block_features(data, starts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


@dataclass
class Model:
    """weight[f] and ratio[f] of each feature, and the bias."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float

    def margin(self, ids: np.ndarray) -> float:
        length = math.sqrt(float(np.square(self.ratio[ids]).sum()))
        return self.bias + (float(self.weight[ids].sum()) / length if length else 0.0)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: float, epochs: int) -> np.ndarray:
    """The weights of an L2-regularized hinge-loss model over sparse rows (ids, values); the last weight is the bias."""
    weights, alpha = np.zeros(size + 1), np.zeros(len(rows))
    order = np.random.default_rng(0)
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, values = rows[i]
            y = labels[i]
            gradient = y * (weights[ids] @ values + weights[size]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                weights[ids] += step * values
                weights[size] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int = FOLDS, held_out: int = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of one 0/1 label, from rows outside the held-out fold."""
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    texts = docs.filter(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out)).select("doc_id", F.col("text").cast("string").alias("text"))
    counts = (
        texts.join(known.hint("merge"), "doc_id").select("text", "label").mapInArrow(_class_counts, "feature long, low long, high long")
        .groupBy("feature").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        .toPandas()  # at most FEATURES + 1 rows
    )
    documents = counts[counts.feature < 0][["low", "high"]].to_numpy().sum(axis=0)
    flat = Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0)
    if not len(documents) or not documents.all():
        return flat
    counts = counts[counts.feature >= 0]
    seen, low, high = counts.feature.to_numpy(), counts.low.to_numpy(), counts.high.to_numpy()
    ratio = np.zeros(FEATURES)
    ratio[seen] = np.log((high + SMOOTHING) / (documents[1] + 2 * SMOOTHING)) - np.log((low + SMOOTHING) / (documents[0] + 2 * SMOOTHING))
    ratio[seen[low + high < LEAST_SUPPORT]] = 0.0
    slots = 1 << 30
    least = max(1, round(slots * min(1.0, sample_rows / float(documents.sum()))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < least).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    sides = {r["doc_id"]: r["label"] for r in chosen}
    got = texts.filter(F.col("doc_id").isin(list(sides))).mapInArrow(_sample_features, "doc_id long, ids array<int>").toPandas() if sides else None
    if got is None or not len(got):
        return flat
    got = got.sort_values("doc_id", kind="stable")
    rows, side = [], []
    for doc_id, ids in zip(got.doc_id, got.ids):
        ids = np.asarray(ids, np.int64)
        values = ratio[ids]
        length = np.linalg.norm(values)
        if length:
            rows.append((ids[values != 0], values[values != 0] / length))
            side.append(1.0 if sides[doc_id] else -1.0)
    weights = dual_coordinate_descent(rows, np.array(side), FEATURES, COST, EPOCHS)
    return Model(weights[:FEATURES] * ratio, ratio, float(weights[FEATURES]))


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score (logistic of the margin) and predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, 3.0 * model.margin(ids)))))
                for _, _, data, starts in blocks(batch.column(2)) for ids in block_features(data, starts)
            ]
            values = pa.array(scores, pa.float64())
            guess = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, guess], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
