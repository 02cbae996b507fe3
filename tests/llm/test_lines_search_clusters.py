"""Line dedup, reversed search and VA-file clustering against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlake.llm import line_dedup, reversed_search, va_clustering

DOCS = "doc_id long, text string, lang string, key string, position int, line string"


def documents(spark, rows, parts=3):
    """Rows (id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "k", 7, "l") for i, t in rows], DOCS).repartition(parts)


# --- line dedup ---


def plain_dedup(rows, least_chars, least_docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            held = holders.get(key(line), ())
            keeper = max((h for h in held if h is not None), default=None)
            if len(held) < least_docs or i == keeper:
                keep.append(line)
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def deduped(spark, rows, **options):
    got = line_dedup.dedup_lines(documents(spark, rows), **options)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_line_dedup_equals_plain_version(spark):
    rng = random.Random(5)
    stock = ["Ä" * 9 + "x", "footer LINE of all", "Footer line of ALL ", "\t footer line of all", "short", "", "  ", "İstanbul kelvin K", "istanbul kelvin k"]
    rows = [(i, "\n".join(rng.choice(stock + [f"own line {i}"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(None, "footer line of all\nx"), (7, None), (8, ""), (3, "footer line of all\nsecond text of one id"), *rows[:4]]
    for chars, docs in ((10, 5), (1, 2), (40, 5)):
        assert deduped(spark, rows, least_chars=chars, least_docs=docs) == plain_dedup(rows, chars, docs)


def test_line_dedup_bounds_and_keeper(spark):
    forty, less = "a" * 40, "ü" * 39
    rows = [(i, f"{forty}\n{less}\nrest {i}\n{forty}") for i in (1, 2, 3, 4, 9)]
    got = deduped(spark, rows)
    assert got == sorted([(i, 4, 2, f"{less}\nrest {i}") for i in (1, 2, 3, 4)] + [(9, 4, 0, rows[-1][1])], key=repr)
    assert all(r[2] == 0 for r in deduped(spark, rows[:4]))  # four documents are too few
    assert all(r[2] == 0 for r in deduped(spark, rows[:4] * 3))  # repeated rows are one document


def test_line_dedup_long_texts_light_and_empty_tables(spark):
    line = "this very line stands in many documents, over and over"
    long_text = "\n".join([line, "own"] * 30_000)
    rows = [(i, long_text if i < 2 else f"{line}\n{i}") for i in range(8)]
    assert deduped(spark, rows) == plain_dedup(rows, 40, 5)
    frequent = line_dedup.dropped_lines  # keys beyond the broadcast ones give the same lines
    lines = line_dedup.exploded_lines(line_dedup._rows(documents(spark, rows + [(20 + i, "y" * 50) for i in range(6)]), "doc_id", "text"), 40)
    few, many = (sorted(map(tuple, frequent(lines, 5, heavy_keys=n).collect())) for n in (1, 100))
    assert few == many and len(few) == 60_000 + 5 + 5
    assert deduped(spark, []) == []


# --- reversed search ---


def plain_search(docs, items, top):
    def terms(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counts = [(i, Counter(terms(t))) for i, t in docs]
    number = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 10 + (90 * n * number) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        out += [(item, k, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, parts=4, **options):
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = reversed_search.search(documents(spark, docs, parts), table, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture
def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Größe", "ÄRA", "1a", "don't", "x_y", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(80)]
    docs += [(None, "w29 w28 größe"), (300, None), (301, ""), (302, " .,- "), *docs[:5], (303, "w5 w6"), (304, "w5 w6"), (305, "W5, w6!")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "unknown"), (53, "w5 w6 w5"), (None, "größe"), (53, "1a")]


def test_search_equals_plain_version(spark, corpus):
    docs, items = corpus
    for top in (1, 10):
        assert searched(spark, docs, items, top=top) == plain_search(docs, items, top)


def test_search_in_blocks_and_pieces(spark, corpus, monkeypatch):
    docs, items = corpus
    assert searched(spark, docs, items, parts=9, block_postings=5) == plain_search(docs, items, 10)
    monkeypatch.setattr(reversed_search, "PIECE_BYTES", 3)
    text = "ab c  défg ab" * 5
    pieces = list(reversed_search.term_pieces(text))
    assert [t for p in pieces for t in p] == text.encode().split() and len(pieces) > 3


def test_search_long_text_and_empty_tables(spark):
    docs = [(1, "rare " + "common word " * 200_000), (2, "common"), (3, "other words")]
    items = [(1, "rare common"), (2, "word")]
    assert searched(spark, docs, items) == plain_search(docs, items, 10)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


# --- VA-file clustering ---


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[place(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centroids)]
    placed = [(i, place(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, j) in placed:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, (d, j) in placed)


def clustered(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    got = va_clustering.cluster_report(table, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in got.collect())


def floats(rng, n, spread=1.0, centre=0.0):
    return [[float(x) for x in rng.normal(centre, spread, 64).astype(np.float32)] for _ in range(n)]


@pytest.mark.parametrize("bits", [2, 3, 8])
def test_clusters_equal_plain_version(spark, bits):
    rng = np.random.default_rng(2)
    vectors = floats(rng, 60) + floats(rng, 60, 0.2, 2.0) + floats(rng, 20, 0.01, -1.0)
    rows = list(enumerate(vectors))
    rows += [rows[3], rows[3], (200, None), (201, vectors[0][:63]), (202, vectors[0] + [0.0]), (203, [*vectors[0][:63], None]),
             (204, [*vectors[0][:63], float("nan")]), (205, [*vectors[0][:63], float("-inf")]), (206, [0.0] * 64), (207, [0.0] * 64), (208, [])]
    assert clustered(spark, rows, centroids=7, bits=bits) == plain_clusters(rows, 7, 3)


def test_clusters_of_equal_vectors_few_vectors_and_none(spark):
    same = [(i, [0.5] * 64) for i in range(20)]  # ties everywhere, empty centroids stay
    assert clustered(spark, same, centroids=4) == plain_clusters(same, 4, 3)
    few = list(enumerate(floats(np.random.default_rng(1), 3)))
    assert clustered(spark, few) == plain_clusters(few, 16, 3)
    assert clustered(spark, [(1, [1.0]), (2, None)]) == []


def test_cells_decide_as_the_vectors_do():
    rng = np.random.default_rng(4)
    whole = rng.integers(-300, 300, (500, 16))
    centroids = whole[:5] // 2
    for bits in (1, 4, 8):
        cells = va_clustering.Cells.from_sample(whole[:100], whole.min(axis=0), whole.max(axis=0), bits)
        numbers = cells.numbers(whole)
        assert (va_clustering.unpacked_cells(va_clustering.packed_cells(numbers, bits), 16, bits) == numbers).all()
        found = va_clustering.decided(numbers, cells.bound_tables(centroids))
        exact = va_clustering.squared_distances(whole, centroids).argmin(axis=1)
        assert ((found == exact) | (found < 0)).all()
        assert bits < 8 or (found >= 0).mean() > 0.7
