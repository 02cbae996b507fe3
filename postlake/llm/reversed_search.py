"""Ranked lexical search the other way round: items are indexed, documents stream by.

The query items are few against the documents, so they are what is indexed: an inverted index over
their terms (term to items), broadcast in blocks of at most ``BLOCK_POSTINGS`` postings. Tasks stream
documents through it. A document's term counts meet the postings of the terms it shares with items;
each item keeps a bounded heap of its best documents, and a task ends by giving out its heaps. Heaps
are merged by item in slices of tasks first, then as a whole.

Two passes over the documents a block: one counts documents, terms and the documents that hold each
indexed term (exact, over all rows), one scores. All scores are 64-bit integers. Of a document only
counts are kept; a long text is cut into pieces of words, so no list of all its words is made.

Null and empty texts have no terms, score nothing and don't count as documents. Items without terms
give no rows. Each row is a document of its own, so repeated rows rank one after the other; equal
scores go by ascending id, null ids last. Repeated item ids are items of their own. Empty tables give no
rows. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
#: Entries (term, item) of the index that is broadcast at once, and with them the terms and items.
BLOCK_POSTINGS = 1_000_000
#: Score cells (documents by items) that a task fills at once.
CELLS = 2_000_000
#: Bytes of one text that are cut into words at once.
PIECE_BYTES = 1_000_000
#: Slices of tasks whose heaps are merged first.
SLICES = 64

# The parts of the weight and of the length norm.
SCALE, SATURATION = 1000, 1_000_000_000
NORM_CONSTANT, NORM_LENGTH = 10, 90

_LAST_ID = np.iinfo(np.int64).max
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time: runs of ASCII letters, digits and other characters beyond ASCII."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@dataclass
class ItemIndex:
    """Terms of a block of items with the items that hold them."""

    items: list[int | None] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    postings: list[list[int]] = field(default_factory=list)
    size: int = 0

    def add(self, item_id: int | None, text: str | None) -> None:
        distinct = {t: None for piece in term_pieces(text) for t in piece}
        for term in distinct:
            number = self.terms.setdefault(term, len(self.terms))
            if number == len(self.postings):
                self.postings.append([])
            self.postings[number].append(len(self.items))
        if distinct:
            self.items.append(item_id)
            self.size += len(distinct)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(start of each term's postings and their end, items of all postings)."""
        starts = np.cumsum([0, *map(len, self.postings)])
        return starts, np.array([i for held in self.postings for i in held], np.int64)


def item_blocks(items: DataFrame, id_col: str, text_col: str, postings: int = BLOCK_POSTINGS) -> Iterator[ItemIndex]:
    """The items as indexes of bounded size; one block at a time is on the driver."""
    index = ItemIndex()
    rows = items.selectExpr(f"cast(`{id_col}` as long) item_id", f"cast(`{text_col}` as string) text")
    for row in rows.toLocalIterator():
        index.add(row["item_id"], row["text"])
        if index.size >= postings:
            yield index
            index = ItemIndex()
    if index.size:
        yield index


def counted(text: str | None, terms: dict[bytes, int]) -> tuple[int, Counter]:
    """(number of terms, occurrences of each indexed term) of a text."""
    total, found = 0, Counter()
    for piece in term_pieces(text):
        total += len(piece)
        found.update(filter(None.__ne__, map(terms.get, piece)))
    return total, found


_DOCS, _TERMS = -1, -2


def _statistics(shared):
    """Per task: documents with terms, their terms, and the documents that hold each indexed term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value[0]
        holders: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total, found = counted(text.as_py(), terms)
                if total:
                    holders[_DOCS] += 1
                    holders[_TERMS] += total
                    holders.update(found.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(holders), pa.int32()), pa.array(list(holders.values()), pa.int64())], ["term", "n"])

    return run


def term_weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


class Heaps:
    """The best documents of each item: (score, -id) in heaps of at most ``top`` entries."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # the score an item's next document must reach

    def update(self, scores: np.ndarray, ids: list[int]) -> None:
        """scores: documents by items."""
        for row, item in zip(*np.nonzero(scores >= self.least)):
            heap, entry = self.heaps[item], (int(scores[row, item]), -ids[row])
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterable[tuple[int, int, int]]:
        """(item, id, score)"""
        return ((item, -minus, score) for item, heap in enumerate(self.heaps) for score, minus in heap)


def _best(shared, weights: np.ndarray, documents: int, all_terms: int, top: int):
    """Per task: the heaps of all items over the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, starts, posted = shared.value
        heaps = Heaps(len(items), top)
        at_once = max(1, CELLS // len(items))
        ids: list[int] = []
        rows: list[np.ndarray] = []
        gains: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def flush() -> None:
            if not ids:
                return
            row, number, gain = np.concatenate(rows), np.concatenate(numbers), np.concatenate(gains)
            width = starts[number + 1] - starts[number]
            entry = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(starts[number], width)
            scores = np.zeros((len(ids), len(items)), np.int64)
            np.add.at(scores.reshape(-1), np.repeat(row, width) * len(items) + posted[entry], np.repeat(gain, width))
            heaps.update(scores, ids)
            for held in (ids, rows, gains, numbers):
                held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total, found = counted(text.as_py(), terms)
                if not found:
                    continue
                norm = NORM_CONSTANT + NORM_LENGTH * total * documents // all_terms
                number = np.fromiter(found.keys(), np.int64, len(found))
                times = np.fromiter(found.values(), np.int64, len(found))
                rows.append(np.full(len(found), len(ids), np.int64))
                numbers.append(number)
                gains.append(weights[number] * (SATURATION * times // (SCALE * times + 8 * norm)))
                ids.append(_LAST_ID if doc_id is None else doc_id)
                if len(ids) == at_once:
                    flush()
        flush()
        found = list(heaps.rows())
        columns = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return run


def _top_rows(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, index: ItemIndex, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items of one block."""
    spark = docs.sparkSession
    starts, posted = index.flat()
    shared = spark.sparkContext.broadcast((index.terms, index.items, starts, posted))
    held = docs.select("text").mapInArrow(_statistics(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {row["term"]: row["n"] for row in held.collect()}  # no more rows than the block has terms, and two
    documents, all_terms = counts.get(_DOCS, 0), counts.get(_TERMS, 0)
    weights = np.array([term_weight(documents, counts.get(k, 0)) for k in range(len(index.terms))], np.int64)
    heaps = docs.select("doc_id", "text").mapInArrow(
        _best(shared, weights, documents, all_terms, top), "item int, doc_id long, score long")
    sliced = _top_rows(heaps.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES))), ["item", "slice"], top)
    merged = _top_rows(sliced.drop("rank", "slice"), ["item"], top)
    # The block's own item ids, as many as it has items.
    names = spark.createDataFrame(list(enumerate(index.items)), "item int, item_id long")
    return merged.join(names, "item").select(
        "item_id", "rank", F.nullif("doc_id", F.lit(_LAST_ID)).alias("doc_id"), "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_postings: int = BLOCK_POSTINGS, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for index in item_blocks(items, item_col, item_text_col, block_postings):
        found = found.unionByName(_search_block(source, index, top))
    return found
