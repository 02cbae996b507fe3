"""Stupid-backoff language-model scores, computed by dealing n-gram counts out by hash.

The n-grams of orders 1 to ``ORDER`` of all documents are counted over the whole corpus. A word is
scored by the longest n-gram that ends with it and occurs at least ``LEAST_COUNT`` times: the share
of its context's occurrences that go on with the word, times ``BACKOFF`` for every order stepped down.
The single word is the last resort, with its share of all words. A document's score is the sum of the
logarithms.

1. Documents are written in blocks of compressed text; a block's words are hashed again where they are needed.
2. Exploded n-grams: a block's distinct n-grams with their counts are dealt out to parts by hash, as steps
   between rising hashes.
3. Count tables: each part adds the blocks' counts up and answers each block with the corpus counts of
   the n-grams it asked for, in its order. As every block adds an n-gram up first, a frequent n-gram
   costs a part one entry per block.
4. Answers meet their block again; each document's logarithms are summed.

Words are lower-cased (A-Z) runs without ASCII white space; null and empty texts have no words and
score 0. N-grams are 64-bit hashes, of which 48 bits and those that tell the parts are compared. One output row per
input row; columns besides the named ones are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.stage import written
from postlake.llm.tokens import blocks, grams, mix, word_hashes

ORDER = 3
BACKOFF = 0.4
LEAST_COUNT = 2
#: Bytes of text in a block, and n-grams that a part gets, about.
BLOCK_TEXT = 8_000_000
PART_GRAMS = 2_000_000
#: Documents that a task gets at once, so that blocks of short texts fill up.
ROWS_AT_ONCE = 2500

_U = np.uint64
_LOW = _U((1 << 48) - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents: their texts in one piece, compressed."""
    for batch in batches:
        for first, last, data, starts in blocks(batch.column(1), BLOCK_TEXT):
            _, rows = word_hashes(data, starts, lower=True)
            packed = zstandard.ZstdCompressor(level=6).compress(data.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([batch.column(0).slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                 pa.array([int(rows[-1])], pa.int64()), pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                ["block", "doc_ids", "n_words", "starts", "texts"])


def _words_of(starts, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words before each document and in all) of a stored block."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return word_hashes(data, np.asarray(starts, np.int64), lower=True)


def _gram_arrays(words: np.ndarray, rows: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 1, 2, ...: the hash of each n-gram and their number before each document; orders don't meet."""
    out = [(mix(words, 61), rows)]
    for n in range(2, order + 1):
        value, at = grams(words, rows, n)
        out.append((mix(value, 60 + n), at))
    return out


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; it doesn't fall as the keys rise."""
    return ((keys >> _U(48)) * _U(parts) >> _U(16)).astype(np.int64)


def _shift(parts: int) -> np.uint64:
    """Low bits of a hash that are not compared: 48 bits and those that tell the parts remain."""
    return _U(max(16 - (parts - 1).bit_length(), 0))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, compressed."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(values) or values.max() <= np.iinfo(kind).max:
            break
    return np.dtype(kind).char.encode() + zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.dtype(data[:1].decode()))


def _requests(parts: int, order: int):
    shift = _shift(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, rows = _words_of(*(batch.column(c)[k].as_py() for c in ("starts", "texts")))
                keys, counts = np.unique(np.concatenate([v for v, _ in _gram_arrays(words, rows, order)]), return_counts=True)
                if not len(keys):
                    continue
                edges = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(edges))
                keys >>= shift
                # A part's keys rise: the first one, then the steps in low and high halves, of which the high ones are small.
                steps = np.diff(keys, prepend=keys[:1])
                steps[edges[full]] = 0
                spans = [slice(edges[p], edges[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array([batch.column("block")[k].as_py()] * len(full)),
                     pa.array(keys[edges[full]].view(np.int64)), pa.array([steps[s].astype(np.uint32).tobytes() for s in spans], pa.binary()),
                     pa.array([_packed(steps[s] >> _U(32)) for s in spans], pa.binary()), pa.array([_packed(counts[s]) for s in spans], pa.binary())],
                    ["part", "block", "first", "low", "high", "counts"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """The summed counts of each block's n-grams in one part."""
    asked = []
    for first, low, high in zip(*(table[c].to_pylist() for c in ("first", "low", "high"))):
        steps = np.frombuffer(low, np.uint32) | _unpacked(high).astype(_U) << _U(32)
        asked.append(np.cumsum(steps, dtype=_U) + np.array([first]).view(_U))
    counts = np.concatenate([_unpacked(c.as_py()) for c in table["counts"]])
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.minimum(np.bincount(place, weights=counts)[place], 2**32 - 1).astype(np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
    return pa.table({
        "block": table["block"], "part": table["part"],
        "totals": pa.array([_packed(total[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()),
    })


def document_scores(words: np.ndarray, rows: np.ndarray, look_up, corpus_words: int, order: int = ORDER) -> np.ndarray:
    """The score of each document; look_up gives the corpus counts of an array of n-gram hashes."""
    arrays = _gram_arrays(words, rows, order)
    counts = [look_up(v).astype(np.float64) for v, _ in arrays]
    position = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    score = np.zeros(len(words))
    open_ = np.ones(len(words), bool)
    level = np.minimum(position + 1, order)  # the longest order that fits
    for n in range(order, 1, -1):
        fits = np.flatnonzero(open_ & (position >= n - 1))
        at = arrays[n - 1][1][row[fits]] + position[fits] - (n - 1)
        whole = counts[n - 1][at]
        context = counts[n - 2][arrays[n - 2][1][row[fits]] + position[fits] - (n - 1)]
        good = whole >= LEAST_COUNT
        chosen = fits[good]
        score[chosen] = np.log(whole[good] / context[good]) + (level[chosen] - n) * np.log(BACKOFF)
        open_[chosen] = False
    last = np.flatnonzero(open_)
    score[last] = np.log(counts[0][last] / max(corpus_words, 1)) + (level[last] - 1) * np.log(BACKOFF)
    return np.bincount(row, weights=score, minlength=len(rows) - 1)


def _scored(corpus_words: int, order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes, sums = [], [], []
        right = right.sort_by("part")
        totals = np.concatenate([_unpacked(t.as_py()) for t in right["totals"]]) if right.num_rows else np.zeros(0, np.uint32)
        for k in range(left.num_rows):
            words, rows = _words_of(*(left[c][k].as_py() for c in ("starts", "texts")))
            keys = np.unique(np.concatenate([v for v, _ in _gram_arrays(words, rows, order)])) if len(words) else np.zeros(0, _U)
            sums.append(document_scores(words, rows, lambda v: totals[np.searchsorted(keys, v)], corpus_words, order))
            ids.extend(left["doc_ids"][k].as_py())
            sizes.append(np.diff(rows))
        n, s = np.concatenate(sizes), np.concatenate(sums)
        mean = np.divide(s, n, out=np.zeros(len(s)), where=n > 0)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n.astype(np.int64)),
            "log_score": pa.array(np.round(s, 6) + 0.0), "mean_log_score": pa.array(np.round(mean, 6) + 0.0)})

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document under the n-gram counts of all documents."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = written(
        source.mapInArrow(_blocks, "block string, doc_ids array<long>, n_words long, starts array<long>, texts binary"), "lm-blocks", ROWS_AT_ONCE)
    corpus_words = stored.agg(F.sum("n_words")).first()[0] or 0
    parts = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-order * corpus_words // PART_GRAMS)))
    asked = stored.select("block", "starts", "texts").mapInArrow(
        _requests(parts, order), "part int, block string, first long, low binary, high binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(_answers, "block string, part int, totals binary")
    return stored.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        _scored(corpus_words, order), "doc_id long, n_words long, log_score double, mean_log_score double")
