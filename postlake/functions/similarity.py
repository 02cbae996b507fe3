"""String similarities Spark lacks, as Arrow UDFs over whole batches.

Both run only on candidate pairs or already filtered rows. Jaro-Winkler is computed for all
pairs of a batch at once with numpy (loops over character positions, not over rows).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7


def _codes(values: list[str], width: int) -> np.ndarray:
    """Code points padded with zeros, one row per string."""
    out = np.zeros((len(values), width), dtype=np.int32)
    for i, value in enumerate(values):
        out[i, : len(value)] = np.frombuffer(value.encode("utf-32-le"), dtype=np.int32)
    return out


def _jaro_winkler_block(left: list[str], right: list[str]) -> np.ndarray:
    n = len(left)
    len_a = np.array([len(v) for v in left])
    len_b = np.array([len(v) for v in right])
    width_a, width_b = max(1, len_a.max()), max(1, len_b.max())
    a, b = _codes(left, width_a), _codes(right, width_b)
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    rows = np.arange(n)
    taken = np.zeros((n, width_b), dtype=bool)
    used = np.zeros((n, width_a), dtype=bool)
    columns = np.arange(width_b)
    for i in range(width_a):
        near = (columns >= (i - reach)[:, None]) & (columns <= (i + reach)[:, None])
        fits = near & ~taken & (b == a[:, i][:, None]) & (columns < len_b[:, None])
        fits &= (i < len_a)[:, None]
        first = fits.argmax(axis=1)
        found = fits[rows, first]
        taken[rows[found], first[found]] = True
        used[found, i] = True
    matches = used.sum(axis=1)
    # Matched characters in order on both sides; unequal positions are half transpositions.
    order_a = np.argsort(~used, axis=1, kind="stable")
    order_b = np.argsort(~taken, axis=1, kind="stable")
    width = min(width_a, width_b)
    seq_a = np.take_along_axis(a, order_a, axis=1)[:, :width]
    seq_b = np.take_along_axis(b, order_b, axis=1)[:, :width]
    live = np.arange(width) < matches[:, None]
    half = ((seq_a != seq_b) & live).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / len_a + matches / len_b + (matches - half) / matches) / 3.0
    jaro = np.where(matches == 0, 0.0, jaro)
    size = min(PREFIX_LENGTH, width_a, width_b)
    same = (a[:, :size] == b[:, :size]) & (a[:, :size] != 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)


def jaro_winkler_values(left: pd.Series, right: pd.Series, block: int = 2048) -> np.ndarray:
    """Scores of aligned strings. Sorting by length keeps each block's matrices narrow."""
    a, b = left.to_numpy(dtype=object), right.to_numpy(dtype=object)
    sizes = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    out = np.zeros(len(a))
    for start in range(0, len(order), block):
        part = order[start : start + block]
        out[part] = _jaro_winkler_block(list(a[part]), list(b[part]))
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity: prefix weight 0.1 over at most 4 characters, applied only
    above a Jaro score of 0.7; NULL when a side is NULL."""
    known = left.notna() & right.notna()
    out = pd.Series(np.nan, index=left.index, dtype="float64")
    if known.any():
        out[known] = jaro_winkler_values(left[known], right[known])
    return out.astype(object).where(known, None)


def _words_trigrams(text: str) -> list[str]:
    """Trigrams in order, each word padded with two blanks before and one after."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]


def word_similarity_value(query: str, text: str) -> float:
    """Greatest similarity between the query's trigram set and any extent of the text's
    ordered trigrams: shared / (query + extent - shared), over distinct trigrams."""
    wanted = set(_words_trigrams(query))
    ordered = _words_trigrams(text)
    if not wanted or not ordered:
        return 0.0
    hits = [i for i, g in enumerate(ordered) if g in wanted]
    best = 0.0
    for at, start in enumerate(hits):
        shared: set[str] = set()
        extent: set[str] = set()
        position = start
        for end in hits[at:]:
            extent.update(ordered[position : end + 1])
            position = end + 1
            shared.add(ordered[end])
            best = max(best, len(shared) / (len(wanted) + len(extent) - len(shared)))
    return best


def word_similarity(query: str):
    """Column function scoring a text column against one fixed query."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_similarity_value(query, t), na_action="ignore").astype(float)

    return score
