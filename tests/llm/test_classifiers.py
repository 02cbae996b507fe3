"""Quality rules, quality classifier and toxicity on small fixtures: counts by brute force, folds, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postlake.llm import quality_classifier, quality_rules, tokens, toxicity

WORDS = [a + b for a in ("lo", "ma", "ti", "re", "so", "na", "ve", "ki") for b in ("ran", "del", "mos", "tin", "gar", "pel", "wis")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", 0.5, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept boolean").repartition(3)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_a_direct_count(spark):
    draw = random.Random(1)
    texts = [None, "", " \n ", "a", "a a a a a a", "a b c d e a b c d e", "x\n\nx\n \n \ny\nx\r\nx", "é\x0bü\x1c\x85b　c", "#*$%&|<> #", "a b c d e " * 3000]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randint(1, 60))) for _ in range(60)]
    texts += ["".join(draw.choice("ab \n\t#é") for _ in range(80)) for _ in range(60)]
    got = quality_rules.measures(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id])


@pytest.fixture(scope="module")
def junk(spark):
    draw = random.Random(8)
    texts, good = [], []
    for i in range(400):
        base = prose(draw, draw.randint(20, 60))
        kind = i % 5
        if kind == 0:
            base = " | ".join(base.split()) if i % 2 else " ".join(w.upper() + "!!" for w in base.split())
        texts.append(base)
        good.append(int(kind != 0))
    return texts, good


def test_quality_rules_reject_what_the_target_lacks(spark, junk):
    texts, good = junk
    texts = [*texts, None, "", "few words"]
    docs = documents(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(200) if good[i]] + [(None,), (3,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted).collect()}
    assert len(got) == len(texts)
    assert all(got[i].kept == bool(g) for i, g in enumerate(good))
    for i, t in enumerate(texts):
        m = plain_measures(t)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        assert got[i].base_failed == failed and not (failed and got[i].kept)
    assert got[len(good)].score == 0.0
    without = quality_rules.quality_rules(docs, trusted.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.score == 0.0 for r in without)
    assert quality_rules.quality_rules(docs.limit(0), trusted).collect() == []


def test_score_is_the_mean_log_ratio_of_the_hashed_grams(spark):
    texts = ["aa bb cc dd ee ff gg hh ii jj", "aa bb zz zz yy ff gg hh ii jj !!", "abcd efgh 12"]
    docs = documents(spark, texts)
    trusted = spark.createDataFrame([(0,)], "doc_id long")
    grams = []
    for t in texts:
        w = re.sub(r"[a-z]{4,}", "w", t).split()
        rows = spark.createDataFrame([(x, None) for x in w] + list(zip(w, w[1:])), "a string, b string")
        grams.append([r[0] for r in rows.selectExpr(
            f"pmod(case when b is null then xxhash64(a) else xxhash64(a, b) end, {quality_rules.BUCKETS})").collect()])
    raw, target, size = Counter(g for x in grams for g in x), Counter(grams[0]), quality_rules.BUCKETS
    ratio = lambda g: (math.log((target[g] + 1) / (sum(target.values()) + size))
                       - math.log((raw[g] + 1) / (sum(raw.values()) + size)))
    for r in quality_rules.quality_rules(docs, trusted).collect():
        want = sum(map(ratio, grams[r.doc_id])) / len(grams[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-6)


def test_classifier_separates_held_out_rows_and_never_learns_from_them(spark, junk):
    texts, good = junk
    docs = documents(spark, [*texts, None, "", "w " * 30_000])
    rows = [(i, g, "s") for i, g in enumerate(good)] + [(5, None, "s"), (None, 1, "s"), (0, good[0], "s"), (99_999, 1, "s")]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(good))]
    got = {r.doc_id: r for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels, "quality")).collect()}
    assert len(got) == len(texts) + 3
    assert [got[i].held_out for i in range(len(good))] == held
    assert all(got[i].predicted == good[i] for i in range(len(good)) if held[i])
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in got.values())
    wrong = spark.createDataFrame([(i, 1 - g if held[i] else g) for i, g in enumerate(good)], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, wrong, "quality")).collect()}
    assert again == {d: r.score for d, r in got.items()}
    none = quality_classifier.fit(docs, labels.filter("quality = 1"), "quality")
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), none).collect() == []


def test_dual_descent_finds_the_maximum_margin():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))]
    w = quality_classifier.dual_coordinate_descent(rows, np.array([1.0, -1.0]), 2, 10.0, 200)
    assert w[0] == pytest.approx(1.0, abs=1e-2) and w[1] == pytest.approx(-1.0, abs=1e-2) and w[2] == pytest.approx(0.0, abs=1e-2)


@pytest.fixture(scope="module")
def toxic_model(spark):
    draw = random.Random(6)
    texts, toxic = [], []
    for i in range(500):
        words = prose(draw, draw.randint(10, 50)).split()
        if i % 4 == 0:
            words[draw.randrange(len(words))] = draw.choice(["idiot", "moron", "clown,"])
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    return docs, toxic, toxicity.fit(docs, labels)


def test_toxic_words_are_found_on_held_out_rows(spark, toxic_model):
    docs, toxic, model = toxic_model
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [got[i].held_out for i in range(500)] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(500)]
    assert all(got[i].predicted == toxic[i] for i in range(500) if got[i].held_out)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_disguised_words_are_restored(spark, toxic_model):
    _, _, model = toxic_model
    hidden = ["such an idi0t", "what a m0r0n!", "you i d i o t", "an i.d.i.o.t here", "moooorooon", "cl0wn", "m-o-r-o-n", "IDIOT", "mor0n."]
    clean = [None, "", "call 555-6835", "loran, del*** ma!!!", "2024 (249) v1.2", "a b c", "3d x2 b2b", "w" * 3000]
    got = [r for r in toxicity.score(documents(spark, hidden + clean), model).collect()]
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id)] == [1] * len(hidden) + [0] * len(clean)
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_every_sign_doubled_letter_and_gap_is_decoded(spark, toxic_model):
    _, _, model = toxic_model
    hidden = [
        "idio+", "(an id10+)", "m0r0n", "(lown", "c|0wn", "1d10t.", "idiiot", "iddiioott", "morron", "mmoorroonn", "m,o,r,o,n", "m'o'r'o'n",
        "m#o#r#o#n", "i·d·i·o·t", "m..o..r..o..n", "i  d  i  o  t", "i\td\ti\to\tt", "m\no\nr\no\nn", "m - o - r - o - n!", "m. o. r. o. n.",
        "such a m o r o n", "y o u i d i o t", "loran/moron", "ma,idi0t,ti", "m" + "0" * 3 + "r0n", "x" * 300 + " m0r0n", "ma-" * 300 + "m0r0n"]
    clean = ["|" * 5000 + "a", "-" * 20_000 + "ab", "a b c d", "- * -", "1 2 3", "12-34-56", "mall, geese!", "* " * 2000]
    got = sorted(toxicity.score(documents(spark, hidden + clean), model).collect(), key=lambda r: r.doc_id)
    assert [(t, r.predicted) for t, r in zip(hidden + clean, got)] == [(t, 1) for t in hidden] + [(t, 0) for t in clean]
    restorer = toxicity.Restorer(model.costs)
    assert {"moron", "idiot"} <= restorer.of("so a m o r o n. or you.i.d.i.o.t")


def test_decoding_is_the_cheapest_path():
    costs = np.random.default_rng(1).uniform(0.5, 6.0, (28, 28, 28))

    def every(token):
        paths = [("", 0.0)]
        for arcs in toxicity.lattice(token):
            paths = [(t + x, c + k + (0.0 if x else 1.0)) for t, c in paths for x, k in arcs]
        code = toxicity._code
        total = lambda t: sum(costs[a, b, c] for a, b, c in zip(*(([27, 27, *map(code, t), 27])[k:] for k in range(3))))
        return min((c + total(t), t) for t, c in paths)[1]

    for token in ("m0r0n", "1d10t", "s*p", "aaab", "i.d.t", "$c|m"):
        assert toxicity.decode(token, costs) == every(token)


def test_no_toxic_labels_leave_the_base_score(spark):
    docs = documents(spark, ["idiot words", None])
    model = toxicity.fit(docs, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def plain_features(text):
    """Feature ids of a text, word by word."""
    def hashed(word):
        data = np.frombuffer(word, np.uint8)
        return tokens.word_hashes(data, np.array([0, len(data)]))[0]

    def shape(word):
        kinds = re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", word))
        return re.sub(rb"a+", b"a", re.sub(rb"A+", b"A", re.sub(rb"[0-9]+", b"9", kinds)))

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    low = [w.lower() for w in words]
    shapes = [np.array([0x5EED], np.uint64) if i and low[i] == low[i - 1] else hashed(shape(w)) for i, w in enumerate(words)]
    size, found = np.uint64(quality_classifier.FEATURES), set()
    found |= {int(tokens.mix(hashed(w), 11)[0] % size) for w in low}
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            run = np.concatenate(shapes[i : i + n])
            found.add(int(tokens.grams(run, np.array([0, n]), n)[0][0] % size))
    return sorted(found)


def test_classifier_rows_equal_a_plain_model(spark, junk):
    """Features, ratios, descent and scores of every row against dictionaries and loops."""
    texts, good = junk
    few = random.Random(2).sample(list(zip(texts, good)), 120)
    texts = [*(t for t, _ in few), None, "", "Twice twice TWICE x9 X99 é"]
    labels = [(i, int(g)) for i, (_, g) in enumerate(few) if i % 5]
    assert len({g for _, g in labels}) == 2
    train = [(i, g) for i, g in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    features = [plain_features(t) for t in texts]
    support, classes = [Counter(), Counter()], Counter(g for _, g in train)
    for i, g in train:
        support[g].update(features[i])

    def ratio(f):
        if support[0][f] + support[1][f] < quality_classifier.LEAST_SUPPORT:
            return 0.0
        return math.log((support[1][f] + 1) / (classes[1] + 2)) - math.log((support[0][f] + 1) / (classes[0] + 2))

    rows = []
    for i, g in train:
        values = {f: r for f in features[i] if (r := ratio(f))}
        length = math.sqrt(sum(v * v for v in values.values()))
        if length:
            rows.append(({f: v / length for f, v in values.items()}, 1 if g else -1))
    weights, bias, alpha = Counter(), 0.0, [0.0] * len(rows)
    order = np.random.default_rng(0)
    for _ in range(quality_classifier.EPOCHS):
        largest = 0.0
        for k in order.permutation(len(rows)):
            values, y = rows[k]
            gradient = y * (sum(weights[f] * v for f, v in values.items()) + bias) - 1
            new = min(max(alpha[k] - gradient / (sum(v * v for v in values.values()) + 1), 0), quality_classifier.COST)
            step, alpha[k] = (new - alpha[k]) * y, new
            for f, v in values.items():
                weights[f] += step * v
            bias += step
            largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    docs = documents(spark, texts)
    model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, found in enumerate(features):
        length = math.sqrt(sum(ratio(f) ** 2 for f in found))
        margin = bias + (sum(weights[f] * ratio(f) for f in found) / length if length else 0.0)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * margin)))), abs=1e-6), i
