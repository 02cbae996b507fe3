"""Toxicity: a noisy channel undoes disguised spelling, then the restored words are scored.

Every token that holds anything but letters, or a doubled letter, becomes a lattice, and so does every
run of tokens that have one character (and any signs) each, whatever white space is between them. Each
character may stand for itself, for the letters it is used for, or for nothing (signs and repeated
letters); a gap, which is a run of white space or signs, may also be a blank. Viterbi decoding finds the
cheapest way through under a character trigram model, whose counts come from all documents, plus the
channel's costs. The gaps stay marked in the reading: besides the words that the cheapest way ends by
blanks, every run of 4 to 24 letters from one gap to another is a restored word. Where a token begins or ends with a sign that
is used for a letter, the cheapest way that reads it as one counts as well. All other tokens stand for
themselves.

Features of a document are its distinct restored words, each by itself, and their first four and five letters. Over
all training documents the toxic and the clean ones that hold a feature are counted, apart for two
halves of the texts (copies fall into one half). A feature is evidence if a lower confidence bound of
its share of toxic documents is high enough, and it is trusted no further than in its worse half; a
document's score is the chance that at least one of its pieces of evidence is right.

Null and empty texts have no evidence and get the base score. Null labels are ignored; without toxic
training documents no feature is evidence. One output row per input row; columns besides the named
ones are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.quality_classifier import fold
from postlake.llm.tokens import blocks

# Letters that a character is used for, and signs that are put between letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "*": "aeiou", "|": "il", "+": "t", "(": "c", "<": "c", "£": "l", "€": "e",
}
SPACERS = ".-_*~'`^:,/\\=+|#·•"
FOLDS, HELD_OUT = 4, 2
LEAST_TOXIC = 4
CONFIDENCE = 2.6
LEAST_SHARE = 0.35
LEAST_HALF_SHARE = 0.5
PREFIXES = (4, 5)
MEMORY = 400_000
FLUSH = 300_000

_SIGNS = 28  # a-z, other letters, blank
_EDGE = ".,;:?!\"'()[]{}<>|%&$#*…«»“”"
_UNREAD = ".,;:?\"'[]{}>%&#…«»“”"  # signs of the edges that stand for no letter
_DOUBLED = re.compile(r"([^\W\d_])\1")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SINGLE = r"(?=\S)[^\w\s]*+(?:\w[^\w\s]*+)?+(?!\S)"  # a token with one letter or digit at most
_SPACED = re.compile(rf"(?<!\S){_SINGLE}(?:\s+{_SINGLE}){{2,}}")
_HEAD = re.compile(r"(?:([^\W\d_])(?!\1))*+")
_LETTER = re.compile(r"[^\W_]")
_CODES = np.full(256, 27, np.int64)
_CODES[ord("a") : ord("z") + 1] = np.arange(26)
_CODES[ord("A") : ord("Z") + 1] = np.arange(26)
_CODES[0x80:] = 26


_READ = {c for c in LEET if not c.isdigit()}


def _code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26 if ord(c) >= 128 else 27


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character trigram counts of one task."""
    counts = np.zeros(_SIGNS**3, np.int64)
    for batch in batches:
        for _, _, data, starts in blocks(batch.column(0)):
            code = _CODES[data]
            keep = np.ones(len(code), bool)
            keep[1:] = (code[1:] < 26) | (code[1:] != code[:-1])  # one sign for a run of blanks or of bytes of other letters
            code = code[keep]
            if len(code) > 2:
                counts += np.bincount(code[:-2] * _SIGNS**2 + code[1:-1] * _SIGNS + code[2:], minlength=_SIGNS**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])


def character_costs(docs: DataFrame) -> np.ndarray:
    """-log p(third | first two) of the smoothed character trigram model of all documents."""
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIGNS**3)
    for gram, n in got.collect():  # at most 28 ** 3 rows
        counts[gram] = n
    cube = counts.reshape(_SIGNS, _SIGNS, _SIGNS)
    lower = cube.sum(axis=0) + 0.5
    lower /= lower.sum(axis=1, keepdims=True)
    return -np.log((cube + 20.0 * lower[None]) / (cube.sum(axis=2, keepdims=True) + 20.0))


def _is_gap(c: str) -> bool:
    return not c.isalnum() and c not in LEET


def lattice(token: str, read_edges: bool = False, start: int = 0) -> list[list[tuple[str, float]]]:
    """For each character or gap what it may stand for ('': nothing, ' ': a word end), with the channel's cost.

    read_edges: signs at the edges that are used for letters are not left out. start: the character to begin with."""
    out = []
    first = next((k for k, c in enumerate(token) if c.isalnum()), len(token))
    last = next((k for k in range(len(token) - 1, -1, -1) if token[k].isalnum()), -1)
    for k in range(start, len(token)):
        c, before = token[k], token[k - 1] if k else ""
        if c.isalpha():
            arcs = [(c, 0.0)]
            if c == before:
                arcs = [(c, 1.5 if token[k - 2 : k] != c * 2 else 6.0), ("", 0.2)]
        elif c.isdigit():
            arcs = [(x, 0.5) for x in LEET.get(c, "")]
            if arcs and c == before:
                arcs.append(("", 0.2))
            elif not arcs or k in (0, len(token) - 1):
                arcs.append(("", 3.0))
        elif before and _is_gap(c) and _is_gap(before):
            continue  # one gap
        else:
            arcs = [(x, 0.5) for x in LEET.get(c, "")]
            inside = first < k < last
            if not (arcs and read_edges) or inside:
                arcs.append(("", 1.5 if inside and c not in SPACERS and not c.isspace() else 0.3))
            if inside:
                arcs.append((" ", 0.5))
        out.append(arcs)
    return out


#: Readings longer than this are cut by what all of them begin with, so that long tokens stay cheap.
LONG = 100
_GAP = "\0"
#: Letters of the restored words that go from any gap to any other.
LEAST_LETTERS, MOST_LETTERS = 4, 24
#: Tokens with more features, and longer ends, are not remembered.
REMEMBERED = 24


def _undoubled(word: str, costs: list[float]) -> str:
    """The reading of a word of letters: the ways of a doubled letter meet again at the next letter, so each is decided alone."""
    out, at = [], 0
    for m in _DOUBLED.finditer(word):
        k = m.start()
        before, letter, after = _code(word[k - 1]) if k else 27, _code(word[k]), _code(word[k + 2]) if k + 2 < len(word) else 27
        inner = (before * _SIGNS + letter) * _SIGNS
        kept = 1.5 + costs[inner + letter] + costs[(letter * _SIGNS + letter) * _SIGNS + after]
        if 1.2 + costs[inner + after] <= kept:
            out.append(word[at : k + 1])
            at = k + 2
    return "".join(out) + word[at:]


def _words(reading: str) -> set[str]:
    """The words that a reading with marked gaps may hold."""
    words = set(reading.replace(_GAP, "").split())
    if _GAP in reading or " " in reading:
        pieces = re.split(f"[{_GAP} ]+", reading)
        words.update(p for p in pieces if len(p) > 1)
        for k in range(len(pieces)):
            word = ""
            for piece in pieces[k:]:
                word += piece
                if len(word) > MOST_LETTERS:
                    break
                if len(word) >= LEAST_LETTERS:
                    words.add(word)
    return words


def decode(token: str, costs: np.ndarray) -> str:
    """The cheapest letters and word ends for a lower-cased token or run."""
    return _reading(token, costs.ravel().tolist()).replace(_GAP, "")


def _reading(token: str, costs: list[float], read_edges: bool = False) -> str:
    """As decode, under costs as a flat list, with _GAP for every gap that is not a blank."""
    head = _HEAD.match(token)[0]  # single letters have one way
    if not head.isalpha():
        head = ""
    done, start = [head], (27, 27, *map(_code, head[-2:]))
    best = {start[-2] * _SIGNS + start[-1]: (0.0, "")}
    for step, arcs in enumerate(lattice(token, read_edges, len(head))):
        mark = _GAP if arcs[-1][0] == " " else ""
        following: dict[int, tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for letter, channel in arcs:
                if letter:
                    place = state * _SIGNS + _code(letter)
                    key, value = place % _SIGNS**2, (cost + channel + costs[place], text + letter)
                else:
                    key, value = state, (cost + channel + 1.0, text + mark)
                if key not in following or value < following[key]:
                    following[key] = value
        best = following
        if step % LONG == LONG - 1:
            common = os.path.commonprefix([text for _, text in best.values()])
            done.append(common)
            best = {key: (cost, text[len(common) :]) for key, (cost, text) in best.items()}
    return "".join(done) + min((cost + costs[state * _SIGNS + 27], text) for state, (cost, text) in best.items())[1]


class Restorer:
    """Restored words and their features, with a bounded memory of tokens."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.ravel().tolist()
        self.memory: dict[str, tuple[str, ...]] = {}
        self.ends: dict[tuple[str, bool], str] = {}

    def reading(self, token: str, read_edges: bool = False) -> str:
        """_reading; what follows the single letters of the start depends on the last two of them only and is remembered."""
        head = _HEAD.match(token)[0]
        known = max(len(head) - 2, 0) if head.isalpha() else 0
        end = token[known:]
        if len(end) > REMEMBERED:
            return token[:known] + _reading(end, self.costs, read_edges)
        found = self.ends.get((end, read_edges))
        if found is None:
            if len(self.ends) >= MEMORY // 4:
                self.ends.clear()
            found = self.ends[end, read_edges] = _reading(end, self.costs, read_edges)
        return token[:known] + found

    def words(self, token: str) -> set[str]:
        """The token as it stands and the words of its readings."""
        core = token.strip(_UNREAD)
        words = {token.strip(_EDGE)}
        if core.isalpha() and not _DOUBLED.search(core):
            words.add(core)
        elif core.isalpha() and not _TRIPLE.search(core):
            words.add(_undoubled(core, self.costs))
        elif core:
            words |= _words(self.reading(token))
            if core[0] in _READ or core[-1] in _READ:
                words |= _words(self.reading(core, True))
        return words - {""}

    def features(self, token: str) -> tuple[str, ...]:
        known = self.memory.get(token)
        if known is None:
            known = _features(self.words(token))
            if len(known) <= REMEMBERED:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[token] = known
        return known

    def of(self, text: str | None) -> set[str]:
        """All features of a whole text."""
        if not text:
            return set()
        text = text.lower()
        found: set[str] = set()
        for token in set(text.split()):
            found.update(self.memory.get(token) or self.features(token))
        for m in _SPACED.finditer(text):
            if len(_LETTER.findall(m[0])) > 1:
                found.update(_features(_words(_reading(m[0], self.costs))))
        return found


def _features(words: set[str]) -> tuple[str, ...]:
    return tuple(words | {f"{w[:n]}~" for w in words for n in PREFIXES if len(w) >= n})


@dataclass
class Model:
    costs: np.ndarray
    evidence: dict[str, float] = field(default_factory=dict)
    base: float = 0.02


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Character costs of all documents and the evidence of all training documents."""
    costs = character_costs(docs)
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    texts = docs.filter(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out)).select("doc_id", F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts, documents = Restorer(costs), {n: Counter() for n in sides}, dict.fromkeys(sides, 0)

        def emit() -> pa.RecordBatch:
            names = list(set().union(*counts.values()))
            columns = [pa.array([counts[side][n] for n in names], pa.int64()) for side in sides]
            for held in counts.values():
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["feature", *sides])

        for batch in batches:
            for text, side in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[sides[side]].update(restorer.of(text.as_py()))
                documents[sides[side]] += 1
                if sum(map(len, counts.values())) > FLUSH:
                    yield emit()
        for side, n in documents.items():
            counts[side][""] = n  # the empty feature stands for the number of documents
        yield emit()

    sides = ("clean_a", "toxic_a", "clean_b", "toxic_b")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) * 2
    counted = (
        texts.join(known.hint("merge"), "doc_id").select("text", (half + F.col("label")).cast("int").alias("side"))
        .mapInArrow(count, "feature string, " + ", ".join(f"{n} long" for n in sides))
        .groupBy("feature").agg(*[F.sum(n).alias(n) for n in sides])
        .withColumns({"clean": F.col("clean_a") + F.col("clean_b"), "toxic": F.col("toxic_a") + F.col("toxic_b")})
    )
    n = F.col("clean") + F.col("toxic")
    share, z2 = F.col("toxic") / n, CONFIDENCE**2
    bound = (share + z2 / (2 * n) - CONFIDENCE * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    worse = F.least(*[(F.col(f"toxic_{h}") + 0.1) / (F.col(f"toxic_{h}") + F.col(f"clean_{h}") + 0.5) for h in "ab"])
    # supported features only: each stands in several toxic documents and in few clean ones
    evident = (F.col("toxic") >= LEAST_TOXIC) & (bound >= LEAST_SHARE) & (worse >= LEAST_HALF_SHARE)
    rows = counted.withColumn("worse", worse).filter((F.col("feature") == "") | evident).select("feature", "clean", "toxic", "worse").collect()
    totals = next((r for r in rows if r["feature"] == ""), None)
    model = Model(costs)
    if totals is not None and totals["toxic"]:
        model.base = min(0.1, 0.2 * totals["toxic"] / (totals["toxic"] + totals["clean"]))
        model.evidence = {r["feature"]: min(r["worse"], 0.99) for r in rows if r["feature"]}
    return model


def score_of(found: set[str], model: Model) -> float:
    left = 1.0 - model.base
    for feature in sorted(found & model.evidence.keys()):
        left *= 1.0 - model.evidence[feature]
    return 1.0 - left


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least 0.3) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.costs)
        for batch in batches:
            scores = [score_of(restorer.of(text.as_py()), model) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.3) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
