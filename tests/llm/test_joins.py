"""N-gram Jaccard join and LM scores against brute force, with large groups of copies."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from postlake.llm import lm_scoring, ngram_jaccard


def documents(spark, texts):
    rows = [(i, t, 0, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, component_id string").repartition(5)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def varied(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    fresh = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    out = [None, "", "  \n", "one", "One", "a b c d", "A b c D", "a b c d e", "a b c d e f", "a b c d e f g", "x " * 4000]
    passage = fresh(55)
    for n in (6, 9, 14, 30, 70, 200):  # pairs of every size, at every distance
        for _ in range(10):
            base = fresh(n)
            out += [" ".join(base)] + [" ".join(varied(draw, base, k)) for k in (0, 1, 1, 2, 3)]
            out.append(" ".join(base + fresh(max(1, n // 4))))
            out.append(" ".join(base[: max(5, n * 3 // 4)]))
    base = fresh(150)  # a large group of near copies and one of exact copies
    out += [" ".join(varied(draw, base, draw.choice((1, 2, 3, 4, 5)))) for _ in range(140)]
    out += [" ".join(base).upper()] * 60
    out += [" ".join(fresh(draw.randint(1, 60)) + passage + fresh(draw.randint(1, 60))) for _ in range(120)]  # a shared passage
    draw.shuffle(out)
    return out


def test_components_equal_all_pairs(spark, texts):
    sets = [plain_set(t) for t in texts]
    want = plain_components(sets)
    got = {r.doc_id: r for r in ngram_jaccard.near_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_words_agree_for_every_linked_pair():
    """The pigeonhole bound: with a margin, a linked pair shares a word that is not empty."""
    draw = np.random.default_rng(3)
    for n in (3, 4, 5, 7, 8, 15, 16, 33, 100, 700):
        for _ in range(60):
            ids = np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            keep = np.sort(draw.permutation(ids)[: max(1, math.ceil(len(ids) * draw.uniform(0.75, 1.0)))])
            both = len(np.intersect1d(ids, keep))
            if 100 * both < 75 * len(ids) or len(keep) == len(ids):
                continue
            shared = [
                np.intersect1d(ngram_jaccard.sketch_words(ids, a)[0], ngram_jaccard.sketch_words(keep, a)[0])
                for a in ngram_jaccard.bands_of(len(ids)) if a in ngram_jaccard.bands_of(len(keep))
            ]
            assert sum(map(len, shared)) > 0


def test_folded_sketches_bound_the_difference():
    draw = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(draw.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[:90], draw.integers(0, 2**63, 40).astype(np.uint64)]))
        s, t = (np.frombuffer(ngram_jaccard.fine_sketch(x), np.uint8) for x in (a, b))
        size = min(len(s), len(t))
        assert np.bitwise_count(ngram_jaccard.fold_to(s, size) ^ ngram_jaccard.fold_to(t, size)).sum() <= len(np.setxor1d(a, b))


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = documents(spark, ["a b c d e f", "A B c d e f", "other words stand here now", None, ""])
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_join_of_nothing(spark):
    assert ngram_jaccard.near_duplicates(documents(spark, [None, ""]).limit(0)).collect() == []
    assert {r.component_id for r in ngram_jaccard.near_duplicates(documents(spark, [None, ""])).collect()} == {0, 1}


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in ngram_jaccard.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(7, 1, 7), (7, 1, 7), (None, 1, 7), (3, 0, 3)], key=str)


def test_rows_are_told_apart_by_their_texts(spark):
    base = "this is one rather long line of words that two or three documents have in common with each other".split()
    near, other = [*base[:-1], "else"], [f"w{k}" for k in range(30)]
    rows = [(5, base), (None, near), (9, other), (9, near), (None, ["z"] * 9), (None, [*other, "more"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 15, 5), (None, 15, 5), (9, 26, 9), (9, 15, 5), (None, 1, None), (None, 27, 9)], key=str)


@pytest.mark.parametrize("cell", [512, 7])
def test_large_groups_that_are_only_partly_linked(spark, monkeypatch, cell):
    """Stars without their centre, chains, and a group whose members are all near each other."""
    monkeypatch.setattr(ngram_jaccard, "CELL", cell)
    draw = random.Random(21)
    fresh = lambda n: [f"v{draw.randrange(5000)}" for _ in range(n)]
    out, star, chain, close = [], fresh(120), fresh(120), fresh(90)
    out += [" ".join(varied(draw, star, 3)) for _ in range(90)]
    out += [" ".join(varied(draw, star, 1)) for _ in range(5)]
    for _ in range(90):
        out.append(" ".join(chain))
        chain = varied(draw, chain, 1)
    out += [" ".join(varied(draw, close, 1)) for _ in range(60)]
    draw.shuffle(out)
    sets = [plain_set(t) for t in out]
    assert [r.component_id for r in ngram_jaccard.near_duplicates(documents(spark, out)).orderBy("doc_id").collect()] == plain_components(sets)


def test_a_cell_gives_a_spanning_forest():
    import pyarrow as pa

    draw = np.random.default_rng(1)
    base = np.unique(draw.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.sort(draw.permutation(base)[:380]) for _ in range(30)] + [np.unique(draw.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(5)]
    table = pa.table({
        "side": pa.array(np.zeros(35, np.int32)), "a": pa.array(range(35)), "component": pa.array(range(35)), "n": pa.array([len(s) for s in sets]),
        "sketch": pa.array([ngram_jaccard.fine_sketch(s) for s in sets]), "ids": pa.array([s.tobytes() for s in sets])})
    found = ngram_jaccard._cells(75)(table)
    assert found.num_rows == 29 and set(found["a"].to_pylist()) | set(found["b"].to_pylist()) == set(range(30))


def test_classes_that_are_not_linked_are_told_apart_by_sketches(monkeypatch):
    """A small set in a cell must not make the sketches of all others too short to tell them apart."""
    import pyarrow as pa

    draw, calls, linked = np.random.default_rng(2), [], ngram_jaccard.linked
    fresh = lambda n: np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
    base = fresh(400)
    sets = [fresh(n) for n in (4, 60, 250, *[400] * 120, 900)] + [base, np.union1d(base, fresh(40)), base[:330], fresh(6000)]
    order = draw.permutation(len(sets))
    sets = [sets[k] for k in order]
    monkeypatch.setattr(ngram_jaccard, "linked", lambda *a: calls.append(1) or linked(*a))
    for sides in (np.zeros(len(sets)), draw.integers(0, 2, len(sets))):
        table = pa.table({
            "side": pa.array(sides.astype(np.int32)), "a": pa.array(range(len(sets))), "component": pa.array(range(len(sets))), "n": pa.array([len(s) for s in sets]),
            "sketch": pa.array([ngram_jaccard.fine_sketch(s) for s in sets]), "ids": pa.array([s.tobytes() for s in sets])})
        found = ngram_jaccard._cells(75)(table)
        near = [k for k, at in enumerate(order) if 124 <= at <= 126]
        want = [(x, y) for x in near for y in near if x < y and linked(sets[x], sets[y], 75) and (sides[x] != sides[y] or not sides.any())]
        assert found.num_rows == min(2, len(want)) and {tuple(sorted(x)) for x in zip(found["a"].to_pylist(), found["b"].to_pylist())} <= set(want)
    assert len(calls) < 10  # of 8,000 pairs


@pytest.mark.parametrize("percent", [75, 40])
def test_blocks_and_packed_words_equal_single_sets(monkeypatch, texts, percent):
    import pyarrow as pa

    monkeypatch.setattr("postlake.llm.tokens.BLOCK_BYTES", 3000)
    monkeypatch.setattr(ngram_jaccard, "PACKED_WORDS", 900)
    monkeypatch.setattr(ngram_jaccard, "PART_WORDS", 1)
    column = pa.array(texts)
    sets = [s.copy() for s in ngram_jaccard.shingle_sets(column)]
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    signed = [r for b in ngram_jaccard._signatures([pa.record_batch([column, column, column], ["a", "b", "c"])]) for r in b.to_pylist()]
    for r, s in zip(signed, sets):
        assert r["n"] == len(s)
        assert (r["class"], r["sketch"]) == ((ngram_jaccard.identity(s), ngram_jaccard.fine_sketch(s)) if len(s) else (None, None))
    classes = {ngram_jaccard.identity(s): s for s in sets if len(s)}
    assert len(classes) == len({frozenset(plain_set(t)) for t in texts} - {frozenset()})
    by, margins = {}, {}
    for name, s in classes.items():
        for band in ngram_jaccard.bands_of(len(s), percent):
            words, margins[name, band.level] = ngram_jaccard.sketch_words(s, band)
            for w in words.tolist():
                by.setdefault((band.level, w), set()).add(name)
    pairs = {(x, y) for held in by.values() if len(held) <= ngram_jaccard.HOT for x in held for y in held if x < y}
    hot = sorted((x, level) for (level, _), held in by.items() if len(held) > ngram_jaccard.HOT for x in held)
    batches = [pa.record_batch([pa.array(texts[k : k + 100], pa.string())], ["text"]) for k in range(0, len(texts), 100)]
    packed = pa.Table.from_batches(list(ngram_jaccard._packed_words(3, percent)(batches)))
    assert packed.num_rows > 9
    met = [r for p in range(3) for r in ngram_jaccard._meet(packed.filter(pa.compute.equal(packed["part"], p))).to_pylist()]
    assert {(r["a"], r["b"]) for r in met if r["kind"] == 0} == pairs
    assert sorted((r["a"], r["level"]) for r in met if r["kind"] == 1) == hot
    assert all(r["margin"] == max(0, margins[r["a"], r["level"]]) for r in met if r["kind"] == 1)


def test_pairs_pass_by_their_sketches_in_batches():
    import pyarrow as pa

    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in (20, 20, 90, 500)]
    sets += [s[: len(s) * 9 // 10] for s in sets]
    pairs = [(x, y) for x in range(8) for y in range(8) if x < y]
    n, sketch = [len(s) for s in sets], [ngram_jaccard.fine_sketch(s) for s in sets]
    batch = pa.record_batch([pa.array(x) for x in zip(*[(a, b, n[a], sketch[a], n[b], sketch[b]) for a, b in pairs])], ["a", "b", "n_a", "s_a", "n_b", "s_b"])
    kept = {(r["a"], r["b"]) for b in ngram_jaccard._near_enough(75)([batch]) for r in b.to_pylist()}

    def differ(x, y):
        s, t = (np.frombuffer(k, np.uint8) for k in (x, y))
        size = min(len(s), len(t))
        return int(np.bitwise_count(ngram_jaccard.fold_to(s, size) ^ ngram_jaccard.fold_to(t, size)).sum())

    assert kept == {(a, b) for a, b in pairs if differ(sketch[a], sketch[b]) * 175 <= (n[a] + n[b]) * 25} >= {(k, k + 4) for k in range(4)}


def test_scores_equal_a_direct_model(spark, texts):
    texts = texts[:260]
    words = [plain_words(t) for t in texts]
    tables = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(tables[0].values())

    def log_share(w, i, n):
        if n == 1:
            return math.log(tables[0][(w[i],)] / total)
        gram = tuple(w[i - n + 1 : i + 1])
        if tables[n - 1][gram] >= 2:
            return math.log(tables[n - 1][gram] / tables[n - 2][gram[:-1]])
        return math.log(0.4) + log_share(w, i, n - 1)

    got = {r.doc_id: r for r in lm_scoring.score(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for d, w in enumerate(words):
        want = sum(log_share(w, i, min(i + 1, 3)) for i in range(len(w)))
        assert got[d].n_words == len(w) and got[d].log_score == pytest.approx(want, abs=2e-6)
        assert got[d].mean_log_score == pytest.approx(want / len(w) if w else 0.0, abs=2e-6)


def test_scores_of_nothing(spark):
    assert lm_scoring.score(documents(spark, [""]).limit(0)).collect() == []
    assert [r.log_score for r in lm_scoring.score(documents(spark, [None, " "])).collect()] == [0.0, 0.0]


def test_requests_and_blocks_of_a_language_model_are_small():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(500)) for _ in range(200)] + [None, ""]
    rows = pa.RecordBatch.from_arrays([pa.array(range(202), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    (block,) = lm_scoring._blocks([rows])
    assert block.get_total_buffer_size() < 0.7 * rows.get_total_buffer_size()
    (asked,) = lm_scoring._requests(40, 3)([block])
    grams = np.unique(np.concatenate([v for v, _ in lm_scoring._gram_arrays(*lm_scoring._words_of(block["starts"][0].as_py(), block["texts"][0].as_py()), 3)]))
    assert sum(asked.column(c).nbytes for c in ("low", "high", "counts")) < 6 * len(grams)  # 10 with whole keys and counts
    answered = lm_scoring._answers(pa.Table.from_batches([asked]))
    assert sum(len(lm_scoring._unpacked(t.as_py())) for t in answered["totals"]) == len(grams)


@pytest.mark.parametrize("values", [[], [0, 255], [256, 1], [2**32 - 1, 0]])
def test_packed_numbers_come_back(values):
    import numpy as np

    assert lm_scoring._unpacked(lm_scoring._packed(np.array(values, np.uint64))).tolist() == values
