"""N-gram Jaccard join by parity sketches: exact links, components and exact-copy classes.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two sets of sizes a and b
reach the similarity t only if they differ in at most (1 - t) / (1 + t) * (a + b) shingles.

1. Copies: documents with equal sets form a class; only classes go on.
2. Sketches: for a size band, a set is XOR-hashed into P words of 64 bits: each shingle goes to one
   word and flips a pattern of its bits there. One shingle changes one word, so the number of words
   in which two sketches differ is at most the symmetric difference. With D the largest difference of
   a linked pair of the band and P > D, linked sketches agree in at least P - D words (pigeonhole).
   Bands double in size; a set close under the next band is sketched for that one too.
3. Join: words are dealt out by their value, packed as numbers, and meet in tasks of bounded
   size. Empty words say nothing and are left out; a word value of up to ``HOT`` classes gives its
   pairs. A sketch's margin is the number of words that must still agree with every linked sketch
   when its empty and hot words are set aside. While the margin is positive, every link of the class is found in
   words that are not hot. Classes without a margin, as the members of large groups of near copies,
   are handled in step 5.
4. Verification: pairs must pass a finer sketch (one bit per shingle, its Hamming distance again at
   most the symmetric difference); then the sets themselves are compared.
5. Groups: of the hot word values, every fourth draws one of its classes as pivot, another one for
   each value, and pairs all its classes with it: fewer pairs than entries, however large the group.
   Classes that then still lie in different components and are joined by a chain of hot values form a
   group; it is cut into cells of bounded size, each pair of classes of like size meets in one cell, where
   rough sketches, fine sketches and then the sets themselves are compared, and a cell gives a spanning forest of the links
   it finds, fewer rows than it has classes. So no link between components is lost and none inside one
   is found twice. Those links join whole components, so only components are labelled again.

Null and empty texts, and texts of blanks: an empty set, linked with nothing, their own component.
Texts of one to four words have one shingle, the whole sequence. Rows with a null id are documents like
others, but no component is named after them: alone, or linked with null ids only, they get null.
Repeated rows fall into one class; rows of one id with different texts are told apart by their texts,
and each row has the component of its own text. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.stage import written
from postlake.llm.tokens import blocks, grams, mix, word_hashes
from postlake.operators.components import connected_components

SHINGLE = 5
#: Similarity as a percentage: linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A word value of more classes is hot.
HOT = 16
#: One hot value in so many draws a pivot.
DRAWN = 4
#: Sketch words that one task of the join gets, about.
TASK_WORDS = 1_000_000
#: Bytes of sets, and classes, on a side of a cell when groups are compared.
CELL_BYTES, CELL = 16 << 20, 8192

_ORDINAL = np.uint64((1 << 20) - 1)
_U = np.uint64


def shingle_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes of row after row, shingles before each row and in all) of every block."""
    for _, _, data, starts in blocks(column):
        words, rows = word_hashes(data, starts, lower=True)
        ids, edges = grams(words, rows, SHINGLE)
        length = np.diff(rows)
        short = (length > 0) & (length < SHINGLE)
        if short.any():
            long, edges = ids, edges + np.concatenate([[0], np.cumsum(short)])
            whole = np.ones(edges[-1], bool)
            whole[edges[:-1][short]] = False
            ids = np.empty(edges[-1], _U)
            ids[whole] = long
            for n in range(1, SHINGLE):
                at = np.flatnonzero(length == n)
                runs = words[(rows[at][:, None] + np.arange(n)).ravel()]
                ids[edges[at]] = grams(runs, n * np.arange(len(at) + 1), n)[0]
        for r in np.flatnonzero(np.diff(edges) > 1):
            ids[edges[r] : edges[r + 1]].sort()
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        new[edges[:-1][np.diff(edges) > 0]] = True
        yield ids[new], np.concatenate([[0], np.cumsum(new)])[edges]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    for ids, edges in shingle_blocks(column):
        for r in range(len(edges) - 1):
            yield ids[edges[r] : edges[r + 1]]


def identities(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit value of each set, as a signed number; 0 for empty ones."""
    size = np.diff(edges)
    full = size > 0
    first = edges[:-1][full]
    found = np.zeros(len(size), np.int64)
    if len(first):
        with np.errstate(over="ignore"):
            both = np.add.reduceat(ids, first) + np.bitwise_xor.reduceat(ids, first) * _U(0x9E3779B97F4A7C15)
            found[full] = mix(both + size[full].astype(_U), 33).view(np.int64)
    return found


def identity(ids: np.ndarray) -> int:
    """The value of one set."""
    return int(identities(ids, np.array([0, len(ids)]))[0])


def fine_sketches(ids: np.ndarray, edges: np.ndarray) -> list[bytes | None]:
    """Of each set one parity bit per shingle, among at least four times as many bits; low hash bits, so it can be folded."""
    n = np.diff(edges)
    size = np.where(n > 0, np.maximum(64, 1 << np.frexp(np.maximum(4 * n - 1, 1))[1].astype(np.int64)), 0)
    at = np.concatenate([[0], np.cumsum(size)])
    place = (ids & np.repeat(size - 1, n).astype(_U)).astype(np.int64) + np.repeat(at[:-1], n)
    bits = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)).tobytes()
    at >>= 3
    return [bits[at[r] : at[r + 1]] or None for r in range(len(n))]


def fine_sketch(ids: np.ndarray) -> bytes:
    """The sketch of one set."""
    return fine_sketches(ids, np.array([0, len(ids)]))[0]


def fold_to(sketch: np.ndarray, size: int) -> np.ndarray:
    """A fine sketch (last axis: bytes or words) brought to that size by XOR of its halves."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


@dataclass(frozen=True)
class Band:
    """Sets whose larger partner has 2**level to 2**(level+1)-1 shingles."""

    level: int
    percent: int = PERCENT

    @property
    def differences(self) -> int:
        largest = (2 << self.level) - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent)

    @property
    def words(self) -> int:
        return -(-self.differences * 6 // 5) + 3

    def differences_from(self, n: int) -> int:
        """The largest difference of a set of n shingles from a linked one in this band."""
        largest = min(100 * n // self.percent, (2 << self.level) - 1)
        return (n + largest) * (100 - self.percent) // (100 + self.percent)


def bands_of(n: int, percent: int = PERCENT) -> list[Band]:
    """The bands in which a set of n shingles may have a partner of another set."""
    own = n.bit_length() - 1
    found = [Band(own, percent)]
    if 100 * n >= percent * (2 << own):
        found.append(Band(own + 1, percent))
    return [b for b in found if b.differences]


def block_words(ids: np.ndarray, edges: np.ndarray, bands: list[Band]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the words that say something, the set of each, margins) of sets that are not empty, each in its band."""
    n = np.diff(edges)
    width = np.array([b.words for b in bands], _U)
    place = (ids >> _U(32)) * np.repeat(width, n) >> _U(32)  # rises with the sorted hashes
    new = np.ones(len(ids), bool)
    new[1:] = place[1:] != place[:-1]
    new[edges[:-1]] = True
    first = np.flatnonzero(new)
    filled = np.diff(np.searchsorted(first, edges))
    seeds = np.array([b.level for b in bands], _U) * _U(0x9E3779B97F4A7C15)  # another scrambling for each band
    with np.errstate(over="ignore"):
        content = np.bitwise_xor.reduceat(ids, first) + place[first] * _U(0xD6E8FEB86659FD93)
        values = [mix(content + np.repeat(seeds, filled), 50)]
    owner = [np.repeat(np.arange(len(n)), filled)]
    margin = filled - np.array([b.differences_from(k) for b, k in zip(bands, n.tolist())], np.int64)
    for r in np.flatnonzero(margin <= 0):  # too few words hold anything: empty words count too, among sets of this kind
        empty = np.setdiff1d(np.arange(bands[r].words, dtype=_U), place[edges[r] : edges[r + 1]])
        values.append(mix(empty, 150 + bands[r].level))
        owner.append(np.full(len(empty), r))
    return np.concatenate(values), np.concatenate(owner), margin


def sketch_words(ids: np.ndarray, band: Band) -> tuple[np.ndarray, int]:
    """(values of the words that say something, margin) of one set."""
    values, _, margin = block_words(ids, np.array([0, len(ids)]), [band])
    return values, int(margin[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names, sketches = [], [], []
        for ids, edges in shingle_blocks(batch.column(1)):
            sizes.append(np.diff(edges))
            names.append(identities(ids, edges))
            sketches += fine_sketches(ids, edges)
        size, name = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, names))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(size), pa.array(name, mask=size == 0), pa.array(sketches, pa.binary())],
            ["doc_id", "key", "n", "class", "sketch"])


#: Sketch words that are packed at once: so many, or ``PART_WORDS`` for each part, but no more than ``MOST_WORDS``.
PACKED_WORDS, PART_WORDS, MOST_WORDS = 1_000_000, 1000, 3_000_000
#: Entries that are packed at once, about; an ordinal has 20 bits.
ENTRIES = 1 << 19
#: Bits of a margin beside the level of its band.
_MARGIN = 25


def _binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The numbers between each two edges as one binary value."""
    offsets = (edges * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all binary values, how many each value holds)."""
    column = column.cast(pa.large_binary()).combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


def _packed_words(parts: int, percent: int):
    """Each task's sketch words, packed by the parts they are dealt to."""
    enough = min(max(PACKED_WORDS, PART_WORDS * parts), MOST_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes among the entries that wait to be packed
        values, owners, names, bands = [], [], [], []
        total = entries = 0

        def packed() -> pa.RecordBatch:
            word, entry = np.concatenate(values), np.concatenate(owners)
            name, band = np.concatenate(names), np.concatenate(bands)
            part = (word % _U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            word, entry, part = word[order], entry[order], part[order]
            new = np.ones(len(word), bool)  # an entry of its part, whose words mostly follow each other
            new[1:] = (entry[1:] != entry[:-1]) | (part[1:] != part[:-1])
            used = np.flatnonzero(new)
            opens = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            edges, at = np.append(opens, len(word)), np.append(np.searchsorted(used, opens), len(used))
            local = np.cumsum(new) - 1 - np.repeat(at[:-1], np.diff(edges))
            for held in (seen, values, owners, names, bands):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(part[opens], pa.int32()), _binaries(word & ~_ORDINAL | local.astype(_U), edges),
                 _binaries(name[entry[used]], at), _binaries(band[entry[used]], at)], ["part", "words", "classes", "bands"])

        for batch in batches:
            for ids, edges in shingle_blocks(batch.column(0)):
                n, name = np.diff(edges), identities(ids, edges)
                fresh = []
                for r in np.flatnonzero(n).tolist():
                    if name[r] not in seen:
                        seen.add(name[r])
                        fresh.append(r)
                found = [(r, b) for r in fresh for b in bands_of(int(n[r]), percent)]
                for own in (True, False):  # a set in its own band, then in the next one
                    some = [(r, b) for r, b in found if (b.level == int(n[r]).bit_length() - 1) == own]
                    if not some:
                        continue
                    rows = np.array([r for r, _ in some])
                    inside = np.zeros(len(n), bool)
                    inside[rows] = True
                    word, owner, margin = block_words(
                        ids[np.repeat(inside, n)], np.concatenate([[0], np.cumsum(n[rows])]), [b for _, b in some])
                    values.append(word)
                    owners.append(owner + entries)
                    names.append(name[rows])
                    level = np.array([b.level for _, b in some], np.int64)
                    bands.append((level << _MARGIN | np.clip(margin, 0, (1 << _MARGIN) - 1)).astype(np.int32))
                    total += len(word)
                    entries += len(rows)
                if total > enough or entries > ENTRIES:
                    yield packed()
                    total = entries = 0
        if total:
            yield packed()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of classes with an equal word (kind 0), and the entries of hot words (kind 1)."""
    (packed, words), (classes, held), (bands, _) = (_numbers(table[c], k) for c, k in (("words", _U), ("classes", np.int64), ("bands", np.int32)))
    word = packed >> _U(20)
    order = np.argsort(word)
    word = word[order]
    same = word[1:] == word[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    word, order = word[shared], order[shared]
    source = np.searchsorted(np.cumsum(words), order, side="right")
    entry = (packed[order] & _ORDINAL).astype(np.int64) + (np.cumsum(held) - held)[source]
    name, band = classes[entry], bands[entry]
    order = np.lexsort((name, word))
    word, name, band = word[order], name[order], band[order]
    once = np.ones(len(word), bool)  # a class comes from every batch that holds a copy
    once[1:] = (word[1:] != word[:-1]) | (name[1:] != name[:-1])
    word, name, band = word[once], name[once], band[once]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.append(first, len(word))), np.diff(np.append(first, len(word))))
    few = size <= HOT
    left, right = [], []
    for step in range(1, HOT):
        meets = np.flatnonzero((word[step:] == word[:-step]) & few[step:]) if len(word) > step else np.zeros(0, np.int64)
        if not len(meets):
            break
        left.append(name[meets])
        right.append(name[meets + step])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[new], b[new]
    hot = ~few
    return pa.table({
        "kind": pa.array(np.concatenate([np.zeros(len(a), np.int32), np.ones(int(hot.sum()), np.int32)])),
        "a": pa.array(np.concatenate([a, name[hot]])), "b": pa.array(np.concatenate([b, word[hot].view(np.int64)])),
        "level": pa.array(np.concatenate([np.zeros(len(a), np.int32), band[hot] >> _MARGIN])),
        "margin": pa.array(np.concatenate([np.zeros(len(a), np.int32), band[hot] & ((1 << _MARGIN) - 1)])),
    })


def _near_enough(percent: int):
    """Pairs whose fine sketches differ in no more bits than linked sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, left, right = (batch.column(2).to_numpy() + batch.column(4).to_numpy(), batch.column(3).to_pylist(), batch.column(5).to_pylist())
            alike: dict[tuple[int, int], list[int]] = {}  # pairs by the sizes of their sketches
            for at, (x, y) in enumerate(zip(left, right)):
                alike.setdefault((len(x), len(y)), []).append(at)
            differs = np.zeros(len(both), np.int64)
            for sizes, rows in alike.items():
                s, t = (
                    fold_to(np.frombuffer(b"".join([side[r] for r in rows]), _U).reshape(len(rows), -1), min(sizes) // 8)
                    for side in (left, right))
                differs[rows] = np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64)
            keep = differs * (100 + percent) <= both * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each class from a text with its key; a text of another class is left out."""
    for batch in batches:
        found = [(name, ids) for name, ids in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))) if len(ids) and identity(ids) == name]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name for name, _ in found], pa.int64()), pa.array([ids.tobytes() for _, ids in found], pa.binary())], ["class", "ids"])


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (s, t) if len(s) <= len(t) else (t, s)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(s) + len(t) - common)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(linked(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sketches_of(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches brought to one size, a row for each word of 64 bits."""
    by: dict[int, list[int]] = {}
    for at, s in enumerate(sketches):
        by.setdefault(len(s), []).append(at)
    out = np.empty((size // 8, len(sketches)), _U)
    for length, at in by.items():
        out[:, at] = fold_to(np.frombuffer(b"".join([sketches[k] for k in at]), _U).reshape(len(at), length // 8), size // 8).T
    return out


def _cells(percent: int):
    """A spanning forest of the links between different components among the classes of one cell.

    A class meets those that are no smaller than it and not too large to be linked, so sketches of like
    size are compared: first folded to a quarter, and what is near enough then as a whole.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table["n"].to_numpy(), kind="stable"))
        side, name, comp, size = (table[c].to_numpy() for c in ("side", "a", "component", "n"))
        raw, ids = table["sketch"].to_pylist(), table["ids"]
        halves = bool((side == 1).any())
        _, tree = np.unique(comp, return_inverse=True)  # components, joined as links are found
        length = np.array([len(s) for s in raw])
        ends = np.searchsorted(percent * size, 100 * size, side="right")  # of the classes not too large
        left, right = [], []  # places of the linked classes
        for width in np.unique(length).tolist():
            start, stop = np.searchsorted(length, [width, width + 1]).tolist()
            bits = _sketches_of(raw[start : ends[stop - 1]], width)
            rough = fold_to(bits.T, max(1, width // 32)).T.copy()
            for r in range(start, stop):
                apart = tree[r + 1 : ends[r]] != tree[r]
                if halves:
                    apart &= side[r + 1 : ends[r]] != side[r]
                if not apart.any():
                    continue
                allowed = (size[r + 1 : ends[r]] + size[r]) * (100 - percent) // (100 + percent)
                at, others = r - start, slice(r + 1 - start, ends[r] - start)
                differs = np.zeros(len(apart), np.int64)
                for word in rough:
                    differs += np.bitwise_count(word[others] ^ word[at])
                near = np.flatnonzero(apart & (differs <= allowed))
                if not len(near):
                    continue
                whole = np.bitwise_count(bits[:, near + others.start] ^ bits[:, at, None]).sum(axis=0, dtype=np.int64)
                near = near[whole <= allowed[near]] + r + 1
                for c in near.tolist():
                    if tree[c] != tree[r] and linked(*(np.frombuffer(ids[k].as_py(), _U) for k in (r, c)), percent):
                        left.append(r)
                        right.append(c)
                        tree[tree == tree[c]] = tree[r]
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        return pa.table({"a": name[a], "b": name[b], "component_a": comp[a], "component_b": comp[b]})

    return run


class JaccardJoin:
    """One run of the join over documents (doc_id, text); the attributes are tables in the shared folder."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT) -> None:
        self.spark, self.percent = docs.sparkSession, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
        self.signed = written(self.docs.mapInArrow(_signatures, "doc_id long, key long, n long, class long, sketch binary"), "jaccard-signatures")
        self.classes = written(
            self.signed.filter("n > 0").groupBy("class").agg(
                F.min("doc_id").alias("least"), F.min("key").alias("key"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-classes")
        self.links = self._all_links()

    def _all_links(self) -> DataFrame:
        found = self._candidates()
        pairs = found.filter("kind = 0").select("a", "b")
        hot = found.filter("kind = 1").select("a", F.col("b").alias("word"), "level", "margin")
        lost = hot.groupBy("a", "level").agg(F.count("*").alias("words"), F.first("margin").alias("margin")).filter("words >= margin")
        hot = written(hot.join(lost.select("a", "level"), ["a", "level"]).select("a", "word"), "jaccard-hot")
        drawing = hot.filter(F.pmod("word", F.lit(DRAWN)) == 0)
        pivots = drawing.groupBy("word").agg(F.min(F.struct(F.xxhash64("a", "word"), "a")).alias("pivot")).select("word", F.col("pivot.a").alias("pivot"))
        drawn = drawing.join(pivots, "word").filter(F.col("a") != F.col("pivot")).select(
            F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b"))
        links = written(self._verified(pairs.unionByName(drawn).distinct()), "jaccard-links")
        self.placed, self.merged = connected_components(links, "a", "b"), None
        if hot.isEmpty():
            return links
        mixed = written(self._mixed(hot), "jaccard-mixed")
        if mixed.isEmpty():
            return links
        rest = written(self._in_groups(mixed), "jaccard-links")
        self.merged = connected_components(rest, "component_a", "component_b")
        return links.unionByName(rest.select("a", "b"))

    def _mixed(self, hot: DataFrame) -> DataFrame:
        """(word, a, component) of the hot words whose classes lie in several components."""
        comps = self.placed.select(F.col("node").alias("a"), "component")
        placed = hot.join(comps, "a", "left").withColumn("component", F.coalesce("component", "a"))
        spans = placed.groupBy("word").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
        return placed.join(spans.select("word"), "word")

    def _candidates(self) -> DataFrame:
        total = self.signed.agg(F.sum("n")).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
        packed = self.docs.select("text").mapInArrow(
            _packed_words(parts, self.percent), "part int, words binary, classes binary, bands binary")
        return written(packed.groupBy("part").applyInArrow(_meet, "kind int, a long, b long, level int, margin int"), "jaccard-candidates")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones among distinct pairs (a, b) of classes."""
        one = self.classes
        sides = pairs
        for side in "ab":
            sides = sides.join(one.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        possible = sides.filter(
            (100 * F.col("n_a") >= self.percent * F.col("n_b")) & (100 * F.col("n_b") >= self.percent * F.col("n_a"))
        ).select("a", "b", "n_a", "s_a", "n_b", "s_b")
        near = written(possible.mapInArrow(_near_enough(self.percent), "a long, b long"), "jaccard-near")
        sets = written(self._sets_of(near.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "jaccard-sets")
        for side in "ab":
            near = near.join(sets.select(F.col("class").alias(side), F.col("ids").alias(f"ids_{side}")), side)
        return near.select("a", "b", "ids_a", "ids_b").mapInArrow(_linked(self.percent), "a long, b long")

    def _sets_of(self, needed: DataFrame) -> DataFrame:
        """(class, ids) of the classes, from the text of each that was signed."""
        keys = needed.join(self.classes.select("class", "key"), "class")
        texts = self.docs.select("key", "text").join(keys, "key").dropDuplicates(["class"])
        return texts.select("class", "text").mapInArrow(_sets, "class long, ids binary")

    def _in_groups(self, mixed: DataFrame) -> DataFrame:
        """Links between components among classes that hot words join, each pair of classes met once."""
        first = mixed.groupBy("word").agg(F.min("a").alias("b"))
        groups = connected_components(mixed.select("word", "a").join(first, "word").select("a", "b"), "a", "b")
        rows = mixed.groupBy("a").agg(F.max("component").alias("component")).join(
            groups.select(F.col("node").alias("a"), F.col("component").alias("group")), "a")
        rows = rows.join(self.classes.select(F.col("class").alias("a"), "n", "sketch"), "a")
        cells = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(8 * F.sum("n") / CELL_BYTES)).cast("int")
        sizes = rows.groupBy("group").agg(cells.alias("cells"))
        sets = written(self._sets_of(mixed.select(F.col("a").alias("class")).distinct()), "jaccard-sets")
        whole = rows.join(sizes, "group").withColumn("cell", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int"))
        whole = whole.join(sets.withColumnRenamed("class", "a"), "a")
        dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
            "group", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"),
            F.when(F.col("cell") <= F.col("other"), 0).otherwise(1).alias("side"), "a", "component", "n", "sketch", "ids")
        return dealt.groupBy("group", "i", "j").applyInArrow(_cells(self.percent), "a long, b long, component_a long, component_b long")

    def components(self) -> DataFrame:
        """(class, component, component_id): the least document of all that a class reaches, and a label of its component."""
        placed = self.classes.select("class", "least").join(self.placed.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        if self.merged is not None:
            placed = placed.join(self.merged.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").withColumn(
                "component", F.coalesce("joined", "component"))
        least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
        return placed.join(least, "component").select("class", "component", "component_id")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    run = JaccardJoin(docs, percent)
    empty = run.signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = run.signed.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "class").join(run.components(), "class")
    return full.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their component: those of its least id, all of a repeated row.

    Of a component with null ids only, the rows of one text stay; rows without words all stay.
    """
    run = JaccardJoin(docs, percent)
    empty = run.signed.filter("n = 0").select("doc_id", "key")
    rows = run.signed.filter("n > 0").select("doc_id", "key", "class").join(run.components(), "class")
    named = rows.filter("doc_id = component_id").select("doc_id", "key")
    nameless = rows.filter("component_id is null").groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    kept = empty.unionByName(named).unionByName(nameless.select("doc_id", "key")).distinct()
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_kept_key"))
    return docs.join(kept, same, "left_semi")
