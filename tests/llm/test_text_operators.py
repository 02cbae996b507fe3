"""Licence scan, token ids, URL filter, benchmark decontamination: whole rows against plain versions."""

import hashlib
import random
import re
import struct
import time
from array import array

import pytest
import sentencepiece

from postlake.llm import decontamination, licenses, sentencepieces, url_filters
from postlake.llm.queries import piece_model

ODD_TEXTS = [None, "", " ", "\n\t\n", "MIT License", "mit license\nmit license MIT LICENSE", "x" * 50_000, "word " * 20_000 + "Apache License"]


def documents(spark, texts):
    """Documents with columns whose names clash with results, and one repeated row."""
    rows = [(i, t, "en", 1.0, "n") for i, t in enumerate(texts)] + [(0, t, "en", 1.0, "n") for t in texts[:1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_words string").repartition(3)


# --- licences


@pytest.mark.parametrize(("text", "postfix", "whole"), [
    ("MIT", ["mit"], True),
    ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"], True),
    ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["mit", "apache-2.0", "or", "bsd-3-clause", "and"], True),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"], True),
    ("(MIT", ["mit"], False), ("MIT AND", ["mit"], False), ("AND MIT", [], False), ("MIT Apache-2.0", ["mit"], False),
    ("", [], False), ("((MIT)) */", ["mit"], True), (")", [], False),
])
def test_expressions_become_postfix(text, postfix, whole):
    assert licenses.to_postfix(text) == (postfix, whole)


def test_evaluation_takes_the_freer_side_of_or_and_the_stricter_of_and():
    value = lambda text: licenses.evaluate(licenses.to_postfix(text)[0])[0]
    assert value("GPL-3.0-only OR MIT") == 1.0
    assert value("GPL-3.0-only AND MIT") == licenses.FREEDOM["gpl"]
    assert licenses.FREEDOM["gpl"] < value("GPL-2.0-only WITH Classpath-exception-2.0") < 1.0


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_equals_a_word_by_word_search(spark):
    texts = [*ODD_TEXTS, "The GNU General Public License, version 3", "see_MIT-License; apache\nlicense", "émit license", "mit license\u00e9",
             "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1-only\n", "Licensed under CC BY-NC 4.0", "mit apache license mit license"]
    got = licenses.license_scan(documents(spark, texts)).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == plain_scan(texts[row.doc_id])
        assert 0.0 <= row.score <= 1.0 and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    by_id = {r.doc_id: r for r in got}
    assert by_id[len(ODD_TEXTS) + 4].labels == "apache-2.0,lgpl-2.1-only,mit"
    assert by_id[len(ODD_TEXTS) + 5].labels == "cc-by-nc"
    assert licenses.license_scan(documents(spark, [])).collect() == []


# --- token ids


def test_token_ids_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_model())
    draw = random.Random(5)
    texts = [*ODD_TEXTS, "  lead and  trail  ", "a▁b ▁", "<s> </s> <unk> <0x41>", "日本語 ｶﾀｶﾅ \U0001f600", "tab\tline\r\n\x00\x7f", " " * 70]
    texts += ["".join(draw.choice("  ▁aab\n\t.é日1<>s/theing'\"") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    got = sentencepieces.encode_documents(documents(spark, texts), piece_model(), keep_ids=True).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        ids = library.encode(texts[row.doc_id] or "", add_bos=True, add_eos=True)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepieces.encode_documents(documents(spark, []), piece_model()).collect() == []


# --- URLs


def plain_judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, path = re.match(r"[^/]*", rest)[0], re.sub(r"^[^/]*", "", rest)
        host = re.sub(r"[A-Z]", lambda m: m[0].lower(), host)
    rule = None
    for h, p, verdict in url_filters.BASE_RULES:
        if f".{host}".endswith(f".{h}") and path.startswith(p) and (rule is None or len(h + p) > len(rule[0])):
            rule = (h + p, verdict)
    canonical = f".{host}#{path}"
    hits = [g for g in url_filters.METHOD_GLOBS if re.fullmatch(".*".join(re.escape(x) for x in g.split("*")), canonical, re.S)]
    return host, path, rule[0] if rule else None, rule[1] if rule else "block" if hits else "allow"


def test_url_filter_equals_rule_by_rule_search(spark):
    urls = [None, "", "no scheme", "http://", "http://A.NET", "http://a.net/", "http://net/x", "http://knet/x", "https://w.example.net/en/", "https://w.example.net/en",
            "http://example.com/de/1?x=/fr/", "http://x.org/fr/y#z", "http://x.org/FR/", "http://best-casino.com/", "http://ü.example.net/en/é", "a://b://net/",
            "http://spam-farm.example.org/en/7", "http://h/wp-login.php", "http://h/x?/wp-login", "http://" + "a" * 9000 + ".net/" + "b" * 9000, "http://*.net/*", "http://x.org/fr/\n"]
    draw = random.Random(2)
    urls += ["".join(draw.choice(["http://", "a.", "net", "/", "example.net", "en/", "?", "#", "org", "/fr/", "X", "spam"]) for _ in range(7)) for _ in range(300)]
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, None, "h", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3)
    got = url_filters.url_filter(df).collect()
    assert len(got) == len(rows)
    assert all((r.host, r.path, r.rule, r.verdict) == plain_judge(urls[r.page_id]) for r in got)
    assert url_filters.url_filter(df.limit(0)).collect() == []


def test_many_globs_cross_word_borders():
    globs = tuple(f"*{k}a*b{k}*" for k in range(60))
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab0123456789") for _ in range(40)).encode() for _ in range(300)]
    hits = url_filters.GlobAutomaton(globs).run(texts)
    for text, row in zip(texts, hits):
        assert [bool(re.fullmatch(g.replace("*", ".*"), text.decode())) for g in globs] == list(row)


# --- decontamination


def distance_inside(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != x), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_items_are_found_up_to_the_edit_budget_and_not_beyond(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    items = [" ".join(word() for _ in range(draw.randint(3, 20))) for _ in range(8)] + [None, "", "...", "Abc"]
    texts = [None, "", "abc", "x ABC! y"]
    for edits in range(0, 14):
        item = list(draw.choice(items[:8]))
        for _ in range(edits):
            k = draw.randrange(len(item))
            item[k : k + 1] = draw.choice([["z"], [], [item[k], "q"]])
        texts.append(f"{word()} {word()}, {''.join(item).upper()}! {word()}")
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = decontamination.contaminated(documents(spark, texts), bench).collect()
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            p, t = decontamination.plain(item), decontamination.plain(text)
            if p and t and (n := distance_inside(p, t)) <= int(len(p) * decontamination.ERROR_RATE):
                want.add((d, i, n))
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and want
    clean = decontamination.without_contaminated(documents(spark, texts), bench)
    assert clean.columns == ["doc_id", "text", "lang", "score", "n_words"]
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert decontamination.contaminated(documents(spark, texts), bench.limit(0)).collect() == []
    assert decontamination.contaminated(documents(spark, []), bench).collect() == []


def test_benchmark_blocks_cover_every_item(spark):
    bench = spark.createDataFrame([(i, f"item number {i}") for i in range(200)], "item_id long, text string")
    found = [n for block in decontamination.item_blocks(bench, 300) for n, _ in block]
    assert sorted(found) == list(range(200))


def test_long_parts_without_blanks_encode_as_the_library_does():
    processor, table = sentencepiece.SentencePieceProcessor(model_file=piece_model()), sentencepieces.piece_table(piece_model())
    japanese, thai = "日本語の文章はとても長い。これは試験です" * 1000, "ภาษาไทยไม่มีช่องว่าง" * 1000
    for text in (japanese, thai, "é" * 20_000, "zq" * 10_000, "".join((japanese[:700], "é" * 3000, "zq!" * 900, thai[:3000], "x" * 5000))):
        ids = array("I", table.encode(text)).tolist()
        assert ids == processor.encode(text, add_bos=True, add_eos=True)
        assert table.decode(array("I", ids).tobytes()) == processor.decode(ids)


def test_licence_places_in_one_pass_and_whole_names():
    text = "mit license general public license " * 20_000
    started = time.perf_counter()
    found = licenses.scan(text, licenses.BASE_PHRASES, licenses.NOTICE_PHRASES)
    assert time.perf_counter() - started < 2
    assert (found["n_base"], found["first_word"], found["last_word"], found["n_words"]) == (40_000, 0, 99_997, 100_000)
    assert [licenses.freedom(x) for x in ("mitre-x", "zlibx", "cc-by-nd-4.0", "cc-by-nc-nd", "apache-2.0", "gplv3", "gpl-2.0+", "cc0-1.0", "bsd-3-clause")] == [
        0.1, 0.1, 0.4, 0.2, 0.95, 0.3, 0.3, 1.0, 1.0]
    for behind in ("", ", see LICENSE", " -->", " */", "</p>", "; x", ".", '"'):
        assert licenses.scan(f"SPDX-License-Identifier: MIT{behind}", {}, {})["score"] == 1.0, behind
    for fault in (" see LICENSE", " (", ") x", " and"):
        assert licenses.scan(f"SPDX-License-Identifier: MIT{fault}", {}, {})["score"] == 0.0, fault
