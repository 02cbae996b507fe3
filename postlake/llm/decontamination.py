"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to lower-case words joined by single blanks. A test item of m characters may be
found with up to k = floor(m * error_rate) edits. It is split into k + 1 pieces; wherever the text
holds it with at most k edits, one piece stands there unchanged. An automaton finds all pieces of all
items in one pass over a text. Around the hits a window as long as the item and its budget is searched
with Myers' bit-parallel algorithm, whose column of differences is one long integer, and the best
distance decides.

Items are searched in blocks of bounded size (``BLOCK_BYTES``); a larger benchmark means more passes,
not a larger broadcast. Null and empty items and texts match nothing; an item met at several places of
a document gives one row, its best place (ties: the first). Repeated documents and items give repeated
rows. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
#: Characters of items whose automaton one pass carries.
BLOCK_BYTES = 4_000_000
SCHEMA = "doc_id long, item_id long, distance int, first_char long, end_char long"

_APART = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower-case words joined by single blanks."""
    return _APART.sub(" ", (text or "").lower()).strip(" ")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 neighbouring pieces of nearly equal length, with their offsets."""
    count = min(budget + 1, len(item))
    cuts = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' masks of one item."""

    def __init__(self, text: str) -> None:
        self.length = len(text)
        self.all = (1 << self.length) - 1
        self.top = 1 << (self.length - 1)
        self.masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(text):
            self.masks[c] |= 1 << k
        self.masks.default_factory = None

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the best place in text, the first one of equals; None beyond most edits."""
        up, down, score, found = self.all, 0, self.length, None
        masks, whole, top = self.masks, self.all, self.top
        for left, (at, c) in zip(range(len(text), 0, -1), enumerate(text)):
            if score - left > most:  # each further character saves one edit at most
                break
            same = masks.get(c, 0)
            steady = ((same & up) + up ^ up) | same | down  # diagonal steps that cost nothing
            rises = down | ~(steady | up) & whole
            falls = up & steady
            if rises & top:
                score += 1
            elif falls & top:
                score -= 1
                if score <= most and (found is None or score < found[0]):
                    found = (score, at + 1)
            rises = rises << 1 & whole
            falls = falls << 1 & whole
            steady = same | down
            up = falls | ~(steady | rises) & whole
            down = rises & steady
        return found


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], error_rate: float):
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    known, budgets = [], []
    for n, (_, text) in enumerate(items):
        budget = int(len(text) * error_rate)
        known.append(Pattern(text))
        budgets.append(budget)
        for offset, piece in pieces(text, budget):
            places[piece].append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, where in places.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, known, budgets


def find_items(text: str, items: tuple[tuple[int, str], ...], error_rate: float) -> list[tuple[int, int, int, int]]:
    """(item id, distance, first and end character of the searched place) of every item that a plain text holds."""
    if not text or not items:
        return []
    automaton, known, budgets = _matcher(items, error_rate)
    starts: dict[int, list[int]] = defaultdict(list)
    for end, (length, where) in automaton.iter(text):
        for n, offset in where:
            starts[n].append(end + 1 - length - offset)
    out = []
    for n, places in starts.items():
        budget, best = budgets[n], None
        places = sorted(set(places))
        k = 0
        while k < len(places):
            first = places[k]
            while k + 1 < len(places) and places[k + 1] - places[k] <= 2 * budget + 1:
                k += 1
            begin = max(0, first - budget)
            got = known[n].best(text[begin : places[k] + known[n].length + budget], budget if best is None else best[0] - 1)
            if got is not None:
                best = (got[0], begin + got[1])
                if not best[0]:
                    break
            k += 1
        if best is not None:
            out.append((items[n][0], best[0], max(0, best[1] - known[n].length), best[1]))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of about block_bytes characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()  # about block_bytes
        block = tuple(sorted((r["item_id"], p) for r in rows if (p := plain(r["text"]))))
        if block:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, first_char, end_char) for every test item that a document holds; characters of the plain text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in item_blocks(benchmark):

        def search(batches: Iterator[pa.RecordBatch], items=block) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            for batch in batches:
                rows = [(doc.as_py(), *hit) for doc, text in zip(*batch.columns) for hit in find_items(plain(text.as_py()), items, error_rate)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "distance", "first_char", "end_char"])

        found = found.unionByName(source.mapInArrow(search, SCHEMA))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no test item."""
    hits = contaminated(docs, benchmark, error_rate).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti")
