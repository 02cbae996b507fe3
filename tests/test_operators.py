import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.functions.similarity import jaro_winkler_values, word_similarity_value
from postlake.operators import breakdown, components, evaluation, fuzzy, merge, policy, salary_stats, search
from postlake.operators.filters import JobFilters, apply_filters, lifecycle
from postlake.operators.percentiles import grouped_percentiles

M = 1_000_000
NOW = datetime(2026, 10, 18, 12, tzinfo=timezone.utc)


def pay_rows():
    def row(title, low, high, currency="IDR", status="DISCLOSED", flags=(), monthly=None):
        monthly = monthly or (low, high)
        return (title, title, status, currency, low, high, *monthly, False, list(flags), "src", title.lower())

    return [
        row("Analis A", 3 * M, 5 * M), row("Analis B", 4 * M, 6 * M), row("Analis C", 5 * M, 7 * M),
        row("Analis D", 6 * M, 8 * M), row("Analis E", 8 * M, 12 * M), row("Edge", 500_000, 500_000),
        row("High", 90 * M, 140 * M, flags=["SALARY_HIGH_OUTLIER"]),
        row("Broken", 2, 897, flags=["SALARY_LOW_OUTLIER", "SALARY_WIDE_RANGE"]), row("Near", 499_999, 500_000),
        row("Reversed", 3 * M, 9 * M, monthly=(9 * M, 3 * M)), row("Dollar", 3_000, 4_000, "USD"),
        row("None", None, None, None, "NOT_DISCLOSED"),
    ]


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(
        pay_rows(),
        "id string, title string, salary_status string, salary_currency string, salary_min bigint, salary_max bigint, "
        "salary_monthly_min bigint, salary_monthly_max bigint, salary_period_assumed boolean, quality_flags array<string>, "
        "primary_source_id string, search_text string",
    ).cache()


def test_salary_statistics_use_comparable_pay_only(jobs):
    row = salary_stats.salary_overview(jobs).first()
    assert (row.total_jobs, row.eligible, row.excluded_implausible) == (12, 7, 3)
    assert (row.p50, row.median_min, row.median_max) == (6 * M, 5 * M, 7 * M)
    assert (row.salary_high_outlier, row.salary_wide_range, row.salary_low_outlier) == (1, 0, 0)
    bins = salary_stats.dense_histogram(jobs).orderBy("lower").collect()
    assert len(bins) == 16 and sum(b["count"] for b in bins) == 7 and bins[0]["count"] == 1 and bins[-1].upper is None
    group = salary_stats.salary_compare(jobs, "source").first()
    assert (group.n, group.jobs_in_group, group.median, group.small_sample) == (7, 12, 6 * M, True)
    with pytest.raises(ValueError):
        salary_stats.salary_compare(jobs, "title")


@pytest.mark.parametrize("bounds, titles", [
    ({"salary_max": 600_000}, {"Edge"}), ({"salary_min": 100 * M}, {"High"}),
    ({"salary_min": 7 * M, "salary_max": 9 * M}, {"Analis C", "Analis D", "Analis E"}), ({"q": " ANALIS b "}, {"Analis B"}),
])
def test_filters(jobs, bounds, titles):
    assert {r.title for r in apply_filters(jobs, JobFilters(**bounds)).collect()} == titles


def test_filters_are_validated():
    for bad in ({"salary_min": 2, "salary_max": 1}, {"q": "x" * 101}, {"city": ("a\x00",)}, {"role_family": ("NOPE",)},
                {"city": tuple("x" for _ in range(41))}, {"salary_min": -1}):
        with pytest.raises(ValueError):
            JobFilters(**bad)
    assert JobFilters(q=" a " * 20).terms() == ["a"] * 20


def test_lifecycle_boundaries(spark):
    tick, day = timedelta(microseconds=1), timedelta(days=1)
    cases = [
        (NOW - 30 * day, None, "POTENTIALLY_ACTIVE"), (NOW - 30 * day - tick, None, "NOT_SEEN_RECENTLY"),
        (NOW, NOW, "POTENTIALLY_ACTIVE"), (NOW, NOW - tick, "EXPIRED_BY_SOURCE"),
        (NOW - 200 * day, NOW + 60 * day, "NOT_SEEN_RECENTLY"), (NOW - day, NOW - 2 * day, "EXPIRED_BY_SOURCE"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, last_seen_at timestamp, expires_at timestamp")
    got = df.select("i", lifecycle(NOW).alias("l")).orderBy("i").collect()
    assert [g.l for g in got] == [c[2] for c in cases]


def test_percentiles_are_exact_under_skew(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.lognormal(10, 2, 60_000), "flat": np.repeat([1.0, 2.0], 500), "one": np.array([7.5]),
              None: rng.integers(0, 40, 300).astype(float), "tiny": np.array([1.0, 2.0, 4.0, 8.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for row in grouped_percentiles(df, ["k"], "v", probs).collect():
        assert list(row)[1:] == pytest.approx([np.quantile(groups[row.k], p) for p in probs]), row.k
    whole = grouped_percentiles(df, [], "v", (0.5,)).first()
    assert whole.p50 == pytest.approx(np.median([v for _, v in rows]))


def test_jaro_winkler_known_values():
    import pandas as pd

    pairs = {("abcd", "abxy"): 0.6667, ("admin gudang", "admin gudang malam"): 0.9333, ("staff accounting", "staff accountant"): 0.95,
             ("dixon", "dicksonx"): 0.8133, ("martha", "marhta"): 0.9611, ("", ""): 0.0, ("a", "b"): 0.0, ("same", "same"): 1.0}
    got = jaro_winkler_values(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got == pytest.approx(list(pairs.values()), abs=1e-4)


def test_similarity_join_is_lossless(spark):
    import duckdb

    rng = random.Random(11)
    words = ["admin", "gudang", "staff", "akuntansi", "senior", "driver", "kasir", "toko", "malam", "sopir", "it"]
    titles = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(150)}
    for title in list(titles):
        for _ in range(3):
            i = rng.randrange(len(title) + 1)
            titles.add((title[:i] + rng.choice("aeu ") + title[i + rng.randint(0, 1):]).strip())
    rows = [("hot" if rng.random() < 0.9 else "b", t) for t in sorted(titles - {""})]
    df = spark.createDataFrame(rows, "block string, t string").repartition(4)
    got = {(r.block, r.left, r.right) for r in fuzzy.similar_pairs(df, ["block"], "t").collect()}
    con = duckdb.connect()
    con.execute("create table t (block varchar, t varchar)")
    con.executemany("insert into t values (?, ?)", rows)
    want = set(con.execute("select a.block, a.t, b.t from t a join t b on a.block = b.block and a.t < b.t where jaro_winkler_similarity(a.t, b.t) >= 0.93").fetchall())
    assert got == want and len(want) > 100
    candidates = fuzzy.candidate_pairs(df.select("block", F.col("t").alias("text")), ["block"])
    assert candidates.count() == candidates.distinct().count()


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(100, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "left bigint, right bigint").repartition(4)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_word_similarity():
    assert word_similarity_value("data engineer", "Senior Data Engineer") == 1.0
    assert word_similarity_value("word", "two words") == pytest.approx(0.8)
    assert word_similarity_value("abc", "xyz") == 0.0


def test_relevance_search_matches_brute_force(spark):
    titles = ["Data Engineer", "Data Analyst", "Engineer Data Center", "Kasir"]
    df = spark.createDataFrame([(i, t, t.lower(), None) for i, t in enumerate(titles)], "id int, title string, search_text string, expires_at timestamp")
    got = [r.id for r in search.search_jobs(df, JobFilters(q="data"), "relevance", 1, 10, NOW).collect()]
    want = sorted((i for i, t in enumerate(titles) if "data" in t.lower()), key=lambda i: (-word_similarity_value("data", titles[i].lower()), i))
    assert got == want


def test_breakdown_top_and_rest(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)] * 2 + [("c",)], "city string")
    rows = breakdown.breakdown(df, "city", limit=3).orderBy(F.desc("count"), F.asc_nulls_last("key")).collect()
    assert [(r.key, r["count"], r.label) for r in rows] == [("a", 3, "a"), ("b", 2, "b"), (None, 2, "Tidak dicantumkan")]
    assert (rows[0].total, rows[0].distinct_values, rows[0].other_count, rows[0].share) == (8, 4, 1, 3 / 8)


def test_source_gate(spark):
    day = timedelta(days=1)
    rows = [("ok", "APPROVED", False, "feed", NOW - 10 * day), ("blocked", "BLOCKED", False, "feed", NOW), ("paused", "APPROVED", True, "feed", NOW),
            ("bare", "APPROVED", False, None, NOW), ("stale", "APPROVED_WITH_CONDITIONS", False, "feed", NOW - 400 * day)]
    df = spark.createDataFrame(rows, "id string, permission_status string, is_paused boolean, connector string, reviewed_at timestamp")
    got = {r.id: (r.a, r.b) for r in df.select("id", policy.refusal_reason("collect", NOW).alias("a"), policy.refusal_reason("import", NOW).alias("b")).collect()}
    assert got["ok"] == (None, None) and got["stale"] == ("policy review has expired", None)
    assert all(got[i][0] for i in ("blocked", "paused", "bare"))


def test_role_evaluation(spark):
    from postlake.functions.classify import role_family

    rows = [("Barista", "FOOD_HOSPITALITY", "FOOD_HOSPITALITY", ""), ("Kasir", "RETAIL_STORE", "RETAIL_STORE", ""), ("Master of Ceremony", "OTHER", "OTHER", ""),
            ("Production Engineer", "PRODUCTION", "ENGINEERING", "PRODUCTION"), ("Juru Parkir", "SECURITY_FACILITIES", "SECURITY_FACILITIES", "")]
    labels = spark.createDataFrame(rows, "title string, reviewer_a string, reviewer_b string, adjudicated string")
    judged = labels.withColumns({"label": evaluation.final_label(), "predicted": role_family("title")})
    s = evaluation.scores(evaluation.confusion(judged, "label", "predicted")).first()
    assert (s.titles, s.coverage, s.precision, s.recall) == (5, pytest.approx(3 / 5), pytest.approx(2 / 3), pytest.approx(2 / 4))
    k = evaluation.cohen_kappa(evaluation.confusion(labels, "reviewer_a", "reviewer_b")).first()
    assert k.agreement == pytest.approx(4 / 5)
    chance = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")], "a string, b string")
    assert evaluation.cohen_kappa(evaluation.confusion(chance, "a", "b")).first().kappa == 0
    bad = spark.createDataFrame([("x", "RETAIL", "LEGAL", ""), ("y", "LEGAL", "OTHER", ""), ("z", "LEGAL", None, "")], labels.schema)
    assert {r.title: r.problem for r in evaluation.label_problems(bad).collect()} == {
        "x": "unknown family in reviewer_a", "y": "no adjudicated label", "z": "both reviewers must label every title"}


def test_registry_keeps_newer_decisions(spark):
    schema = "id string, permission_status string, reviewed_at timestamp, is_paused boolean"
    old = spark.createDataFrame([("a", "APPROVED", NOW, False), ("b", "BLOCKED", NOW, True)], schema)
    new = spark.createDataFrame([("a", "BLOCKED", NOW - timedelta(days=9)), ("b", "APPROVED", NOW + timedelta(days=9)), ("c", "BLOCKED", NOW)], "id string, permission_status string, reviewed_at timestamp")
    table, audit = merge.sync_registry(old, new)
    assert {r.id: r.permission_status for r in table.collect()} == {"a": "APPROVED", "b": "APPROVED", "c": "BLOCKED"}
    assert {(r.entity_id, r.action) for r in audit.collect()} == {("b", "source.permission_changed"), ("c", "source.created")}
    decide = spark.createDataFrame([("a", "ops", "set_status", "BLOCKED", "terms", ""), ("b", "ops", "resume", None, "try", None)],
                                   "id string, actor string, action string, status string, reason string, evidence_url string")
    table, audit = merge.apply_decisions(old, decide, NOW)
    assert {r.id: (r.permission_status, r.is_paused) for r in table.collect()} == {"a": ("APPROVED", False), "b": ("BLOCKED", True)}
    assert audit.filter("refusal is not null").count() == 2


def test_similarity_join_over_many_tiles(spark, monkeypatch):
    import duckdb

    rng = random.Random(5)
    monkeypatch.setattr(fuzzy, "TILE", 20)  # a block is joined tile by tile, not through keys of single characters
    stems = ["".join(rng.choices("ab cde+#", k=rng.randint(3, 60))).strip() + "a" * rng.choice((0, 0, 40)) for _ in range(50)]
    titles = {t[:i] + rng.choice(["", "x", "u"]) + t[i:] for t in stems for i in (0, 2, 5, len(t))} - {""}
    rows = [(k, t) for t in sorted(titles) for k in ("one", None)]
    df = spark.createDataFrame(rows, "block string, t string")
    got = [(r.block, r.left, r.right) for r in fuzzy.similar_pairs(df, ["block"], "t").collect()]
    con = duckdb.connect()
    con.execute("create table t (block varchar, t varchar)")
    con.executemany("insert into t values (?, ?)", rows)
    want = set(con.execute("select a.block, a.t, b.t from t a join t b on a.block = b.block and a.t < b.t where jaro_winkler_similarity(a.t, b.t) >= 0.93").fetchall())
    assert set(got) == want and len(got) == len(want) > 100
    pairs = fuzzy.candidate_pairs(df.select("block", F.col("t").alias("text")).distinct(), ["block"])
    assert "ArrayIntersect" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_few_groups_are_not_shuffled_by_group(spark):
    df = spark.range(3000).selectExpr("case when id % 3 > 0 then id % 3 end as k", "cast(id as double) as v")
    out = grouped_percentiles(df, ["k"], "v", (0.5,))
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k or 0, r.p50) for r in out.collect()) == [(0, 1498.5), (1, 1499.5), (2, 1500.5)]
