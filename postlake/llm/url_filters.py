"""URL filter: all glob rules as one bit-parallel automaton, run over many canonical URLs at once.

A rule is a glob over the canonical URL ``.host#path``: ``*`` stands for any run, every other
character for itself. The states of all rules lie side by side in a row of 64-bit words. For each
character of the URL the row is shifted by one bit (carries pass from word to word), masked with the
character's word row, and joined with the states under a ``*``, which stay. A block of URLs advances
together, one character position at a time, longest URLs first, so the state is a matrix of
(URLs, words) and no URL meets the rules one by one.

Null and URLs without ``://``: host and path empty, no contract rule fits, the method's default
holds. One output row per input row; columns besides the id and the URL are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Contract rules as (host, path, verdict).
BASE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# The method's own globs over ".host#path"; a URL that no contract rule fits is blocked by any of them.
METHOD_GLOBS = (
    "*.spam*#*", "*-spam.*#*", "*casino*#*", "*.adult.*#*", "*.xxx#*", "*phish*#*", "*#*/wp-login*", "*#*/doorway/*", "*#*/cgi-bin/*",
)
SEPARATOR = "#"  # stands in no host and no path
BLOCK_CELLS = 2_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string, method_globs array<string>"


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) as the contract cuts them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule_glob(host: str, path: str) -> str:
    """A host-and-subdomains rule with a path start, as a glob."""
    return f"*.{host}{SEPARATOR}{path}*"


class GlobAutomaton:
    """Shift-And masks of many globs over UTF-8 bytes."""

    def __init__(self, globs: tuple[str, ...]) -> None:
        states: list[int | None] = []  # the byte that leads into a state, None for a start state
        loops: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        for glob in globs:
            self.starts.append(len(states))
            states.append(None)
            for byte in glob.encode("utf-8", "surrogatepass"):
                if byte == ord("*"):
                    loops.append(len(states) - 1)
                else:
                    states.append(byte)
            self.ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.into = np.zeros((256, self.words), np.uint64)
        for bit, byte in enumerate(states):
            if byte is not None:
                self.into[byte, bit // 64] |= np.uint64(1 << bit % 64)
        self.loop = self._row(loops)
        self.initial = self._row(self.starts)

    def _row(self, bits: list[int]) -> np.ndarray:
        row = np.zeros(self.words, np.uint64)
        for bit in bits:
            row[bit // 64] |= np.uint64(1 << bit % 64)
        return row

    def run(self, urls: list[bytes]) -> np.ndarray:
        """A boolean matrix: which URL is matched by which glob."""
        hits = np.zeros((len(urls), len(self.ends)), bool)
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        first = 0
        while first < len(urls):
            last = first + max(1, BLOCK_CELLS // max(1, int(lengths[order[first]])))
            block = order[first:last]
            state = self._advance([urls[i] for i in block], lengths[block])
            for k, bit in enumerate(self.ends):
                hits[block, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            first = last
        return hits

    def _advance(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths[0]) if len(urls) else 0
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in urls), np.uint8).reshape(len(urls), width)
        state = np.tile(self.initial, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        alive = np.searchsorted(-lengths, -np.arange(width), side="left")  # URLs longer than a position come first
        for at in range(width):
            now = state[: alive[at]]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.into[text[: alive[at], at]]
            moved |= now & self.loop
            state[: alive[at]] = moved
        return state


@lru_cache(maxsize=8)
def _automaton(globs: tuple[str, ...]) -> GlobAutomaton:
    return GlobAutomaton(globs)


def judge(urls: list[str | None], rules=BASE_RULES, globs: tuple[str, ...] = METHOD_GLOBS) -> list[tuple]:
    """(host, path, rule, verdict, method globs that match) of each URL; the longest rule wins, then a block."""
    parts = [split_url(u) for u in urls]
    texts = [f".{h}{SEPARATOR}{p}".encode("utf-8", "surrogatepass") for h, p in parts]
    ranked = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "block"))
    hits = _automaton((*(rule_glob(h, p) for h, p, _ in ranked), *globs)).run(texts)
    out = []
    for (host, path), row in zip(parts, hits):
        fitting = np.flatnonzero(row[: len(ranked)])
        own = [globs[k] for k in np.flatnonzero(row[len(ranked) :])]
        if len(fitting):
            rule = ranked[fitting[-1]]
            out.append((host, path, rule[0] + rule[1], rule[2], own))
        else:
            out.append((host, path, None, "block" if own else "allow", own))
    return out


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=BASE_RULES, globs: tuple[str, ...] = METHOD_GLOBS) -> DataFrame:
    """One row per page: host, path, winning rule and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*judge(batch.column(1).to_pylist(), rules, globs))) or [[]] * 5
            arrays = [pa.array(list(c), pa.string()) for c in columns[:4]] + [pa.array(list(columns[4]), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["page_id", "host", "path", "rule", "verdict", "method_globs"])

    source = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url")
    return source.mapInArrow(run, SCHEMA)
