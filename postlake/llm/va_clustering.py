"""Centroid clustering over a VA-file: vectors as few-bit cells, full vectors only where cells don't decide.

Vectors become integers, floor(64 * x). Two tables are written: whole vectors, and a VA-file with
``BITS`` bits per dimension, the number of the cell that holds each component. For a centroid, tables
by dimension and cell give the least and the largest squared difference; added up they are an interval
for its squared distance. Both are taken less the squared difference from the middle of all centroids:
that changes no comparison, and makes intervals narrower the closer centroids lie together. A vector
is decided if one centroid's upper bound is below all other lower bounds (or equal to that of a larger
number, which loses ties); only otherwise is the full vector read.

Rounds move centroids to exact floored means. The first round has to add up all vectors, so it reads
both tables' columns from the wide one. A later round reads the VA-file alone, with the tables of
the centroids before and after: a vector decided for the same centroid under both adds nothing. The
rest, undecided or moved, is fetched by number from the wide table and moves its exact components from
one sum to another. The last assignment needs every distance and reads the wide table again.

Cells are bounded by quantiles of at most ``BORDER_SAMPLE`` vectors (those with the smallest hash) and,
outside, by the exact least and largest component of all vectors; every vector is in the VA-file. What
reaches the driver is bounded by centroids, dimensions and that sample. Sums are pre-added per task.

Rows without a vector, with another number of components, or with a null, infinite, NaN component or
one of 2**21 or more in size (whose squared distances 64 bits don't hold) are left out. Repeated rows
are vectors of their own; null ids hash like the text ``1:`` and come out as null. With fewer vectors
than centroids each vector starts one. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.stage import written

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
#: Bits per dimension of a cell number.
BITS = 8
#: Vectors whose quantiles bound the cells.
BORDER_SAMPLE = 4096
#: Components are floor(SCALE * x).
SCALE = 64
LARGEST = 1 << 21

_STORED = np.dtype("<i4")




def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, hash, whole): the usable vectors in integers, with the hash that orders them."""
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    usable: Column = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = named.filter((F.size("v") == dimensions) & usable)
    return kept.select(
        "vec_id", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("hash"),
        F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("whole"),
    )


@dataclass(frozen=True)
class Cells:
    """Cell borders: of dimension d, cell j holds the components from low[d, j] to high[d, j]."""

    low: np.ndarray
    high: np.ndarray
    bits: int

    @classmethod
    def from_sample(cls, sample: np.ndarray, least: np.ndarray, largest: np.ndarray, bits: int) -> Cells:
        inner = np.quantile(sample, np.arange(1, 1 << bits) / (1 << bits), axis=0, method="lower").T.astype(np.int64)
        low = np.concatenate([least[:, None], np.maximum(inner + 1, least[:, None])], axis=1)
        high = np.concatenate([inner, largest[:, None]], axis=1)
        return cls(low, high, bits)

    def numbers(self, whole: np.ndarray) -> np.ndarray:
        """The cell of every component (vectors by dimensions)."""
        cells = np.empty(whole.shape, np.uint8)
        for d in range(whole.shape[1]):
            cells[:, d] = np.searchsorted(self.high[d, :-1], whole[:, d])
        return cells

    def bound_tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) squared difference from each centroid, less that from the centroids' middle, by dimension, cell, centroid.

        What the middle takes off is the same for all centroids of a vector; what is left is linear in the component,
        so its ends are those of the cell, and it is narrow where centroids lie close together.
        """
        middle = centroids.sum(axis=0) // len(centroids)
        c, m = centroids.T[:, None, :], middle[:, None, None]
        at_low, at_high = (c * c - m * m - 2 * (c - m) * end[:, :, None] for end in (self.low, self.high))
        return np.minimum(at_low, at_high), np.maximum(at_low, at_high)


def packed_cells(cells: np.ndarray, bits: int) -> np.ndarray:
    """The cell numbers of each vector, bits after bits."""
    flat = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:]
    return np.packbits(flat.reshape(len(cells), -1), axis=1)


def unpacked_cells(packed: np.ndarray, dimensions: int, bits: int) -> np.ndarray:
    flat = np.zeros((len(packed), dimensions, 8), np.uint8)
    flat[:, :, 8 - bits:] = np.unpackbits(packed, axis=1, count=dimensions * bits).reshape(len(packed), dimensions, bits)
    return np.packbits(flat, axis=2)[:, :, 0]


def decided(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The centroid of each vector as far as cells tell; -1 where intervals overlap."""
    least_table, largest_table = tables
    count = least_table.shape[2]
    least = np.zeros((len(cells), count), np.int64)
    largest = np.zeros((len(cells), count), np.int64)
    for d in range(cells.shape[1]):
        least += least_table[d][cells[:, d]]
        largest += largest_table[d][cells[:, d]]
    best = largest.argmin(axis=1)
    bound = largest[np.arange(len(cells)), best][:, None]
    others = np.arange(count)[None, :]
    loses = (bound < least) | (bound == least) & (best[:, None] < others) | (best[:, None] == others)
    return np.where(loses.all(axis=1), best, -1)


def squared_distances(whole: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    out = np.empty((len(whole), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        difference = whole - c
        out[:, j] = np.einsum("nd,nd->n", difference, difference)
    return out


def assign(cells: np.ndarray, whole: np.ndarray, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, ties to the smaller number; full vectors are used where cells don't decide."""
    nearest = decided(cells, tables)
    open_ = np.flatnonzero(nearest < 0)
    if len(open_):
        nearest[open_] = squared_distances(whole[open_], centroids).argmin(axis=1)  # argmin takes the first of equal ones
    return nearest


def _rows(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """A column of equally long binaries as an array of rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _cells(column: pa.Array, dimensions: int, bits: int) -> np.ndarray:
    return unpacked_cells(_rows(column, np.uint8, -(-dimensions * bits // 8)), dimensions, bits)


def _whole(column: pa.Array, dimensions: int) -> np.ndarray:
    return _rows(column, _STORED, dimensions).astype(np.int64)


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _integers(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _extremes(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = largest = None
        for batch in batches:
            if batch.num_rows:
                whole = _integers(batch.column(0), dimensions)
                low, high = whole.min(axis=0), whole.max(axis=0)
                least, largest = (low, high) if least is None else (np.minimum(least, low), np.maximum(largest, high))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array(least), pa.array(largest)], ["d", "low", "high"])

    return run


def _celled(cells: Cells, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = _integers(batch.column(2), dimensions)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), _binaries(packed_cells(cells.numbers(whole), cells.bits)), _binaries(whole.astype(_STORED))],
                    ["number", "vec_id", "cells", "whole"])

    return run


_SUMS = "cluster int, d int, value long"


def _sum_batch(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(cluster, dimension, sum) rows; dimension -1 holds the number of vectors."""
    value = np.concatenate([counts[:, None], sums], axis=1)
    cluster, d = np.indices(value.shape)
    keep = value.reshape(-1) != 0
    columns = (cluster.reshape(-1)[keep], d.reshape(-1)[keep] - 1)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c.astype(np.int32)) for c in columns), pa.array(value.reshape(-1)[keep])], ["cluster", "d", "value"])


def _first_sums(tables, centroids: np.ndarray, bits: int):
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                cells, whole = _cells(batch.column(0), dimensions, bits), _whole(batch.column(1), dimensions)
                nearest = assign(cells, whole, tables, centroids)
                np.add.at(sums, nearest, whole)
                counts += np.bincount(nearest, minlength=k)
        yield _sum_batch(sums, counts)

    return run


def _unsettled(before, after, dimensions: int, bits: int):
    """Numbers of the vectors that the cells don't keep in one cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _cells(batch.column(1), dimensions, bits)
                now = decided(cells, after)
                moved = (now < 0) | (now != decided(cells, before))
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["number"]).filter(pa.array(moved))

    return run


def _moved_sums(old: np.ndarray, new: np.ndarray):
    """What fetched vectors take from their former cluster's sum and give to their new one's."""
    k, dimensions = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                whole = _whole(batch.column(0), dimensions)
                left, joined = squared_distances(whole, old).argmin(axis=1), squared_distances(whole, new).argmin(axis=1)
                moves = np.flatnonzero(left != joined)
                np.subtract.at(sums, left[moves], whole[moves])
                np.add.at(sums, joined[moves], whole[moves])
                counts += np.bincount(joined[moves], minlength=k) - np.bincount(left[moves], minlength=k)
        yield _sum_batch(sums, counts)

    return run


def _final(tables, centroids: np.ndarray, bits: int):
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, whole = _cells(batch.column(1), dimensions, bits), _whole(batch.column(2), dimensions)
                nearest = assign(cells, whole, tables, centroids)
                difference = whole - centroids[nearest]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(np.einsum("nd,nd->n", difference, difference))],
                    ["vec_id", "cluster", "distance"])

    return run


class VaFile:
    """The wide table of vectors and the narrow one of cells, written once."""

    def __init__(self, kept: DataFrame, centroids: int, dimensions: int, bits: int = BITS) -> None:
        self.dimensions = dimensions
        sample = kept.orderBy("hash", "vec_id", "whole").limit(max(BORDER_SAMPLE, centroids)).select("whole").collect()
        self.start = np.array([r["whole"] for r in sample[:centroids]], np.int64).reshape(-1, dimensions)
        if not sample:
            return
        ends = kept.select("whole").mapInArrow(_extremes(dimensions), "d int, low long, high long")
        rows = ends.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
        self.cells = Cells.from_sample(
            np.array([r["whole"] for r in sample], np.int64), np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]), bits)
        numbered = kept.select(F.monotonically_increasing_id().alias("number"), "vec_id", "whole")
        self.vectors = written(
            numbered.mapInArrow(_celled(self.cells, dimensions), "number long, vec_id long, cells binary, whole binary"), "va-vectors")
        # From the written table, so the numbers are those of the vectors whatever task is run again.
        self.file = written(self.vectors.select("number", "cells"), "va-cells")

    def tables(self, centroids: np.ndarray):
        return self.cells.bound_tables(centroids)

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(component sums, numbers of vectors) per cluster, over all vectors."""
        part = self.vectors.select("cells", "whole").mapInArrow(_first_sums(self.tables(centroids), centroids, self.cells.bits), _SUMS)
        return self._added(part, centroids.shape)

    def unsettled(self, old: np.ndarray, new: np.ndarray) -> DataFrame:
        return self.file.mapInArrow(_unsettled(self.tables(old), self.tables(new), self.dimensions, self.cells.bits), "number long")

    def moved(self, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How sums and numbers change when old centroids give way to new ones; fetches the unsettled vectors only."""
        fetched = self.vectors.select("number", "whole").join(self.unsettled(old, new), "number", "left_semi")
        return self._added(fetched.select("whole").mapInArrow(_moved_sums(old, new), _SUMS), new.shape)

    @staticmethod
    def _added(part: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for row in part.groupBy("cluster", "d").agg(F.sum("value").alias("value")).collect():
            if row["d"] < 0:
                counts[row["cluster"]] = row["value"]
            else:
                sums[row["cluster"], row["d"]] = row["value"]
        return sums, counts


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) per kept vector as a written table, the final centroids)."""
    file = VaFile(kept_vectors(vectors, dimensions, id_col, vector_col), centroids, dimensions, bits)
    now = file.start
    if not len(now):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), now
    sums = counts = before = None
    for _ in range(rounds):
        if before is None:
            sums, counts = file.sums(now)
        else:
            more_sums, more_counts = file.moved(before, now)
            sums, counts = sums + more_sums, counts + more_counts
        before, now = now, np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], now)
    placed = file.vectors.select("vec_id", "cells", "whole").mapInArrow(_final(file.tables(now), now, bits), "vec_id long, cluster int, distance long")
    return written(placed, "va-clusters"), now


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """The clusters with the inertia of each and of all, and a digest of each centroid."""
    placed, centroids = cluster(vectors, **options)
    spread = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid
    rows = [(j, spread.get(j, 0), centroid_digest(c)) for j, c in enumerate(centroids)]
    names = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(names), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(spread.values())).cast("long").alias("inertia"), "centroid_sha256")
