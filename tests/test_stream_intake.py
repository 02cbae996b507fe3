"""Streams of captures: one pass per batch, one state per key, order and lateness without effect."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postlake import schemas
from postlake.plans.silver import parse_captures
from postlake.sources.lake import read_captures
from postlake.streaming import jobs as stream
from postlake.streaming import sightings

AT = datetime(2026, 10, 1, tzinfo=timezone.utc)


def capture(url, day=0, result="ok", titles=("Welder",)):
    postings = json.dumps([{"@type": "JobPosting", "title": t} for t in titles]) if titles is not None else None
    return ("c", url, "a.id", AT, f"d{day}", None, None, None, AT + timedelta(days=day), 200, result, 1, 0, postings, AT, "v")


def put(spark, path, *rows):
    spark.createDataFrame(list(rows), schemas.CAPTURE).coalesce(1).write.mode("append").parquet(path)


def test_batches_give_observations_and_rejects_in_one_pass(spark, tmp_path, monkeypatch):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put(spark, source + "/a", capture("https://a.id/1", titles=("Welder", "Cook")), capture("https://a.id/2", result="network", titles=None))
    put(spark, source + "/imports/board/b", capture("https://b.id/1"), capture("https://b.id/2", titles=()), capture("https://b.id/3", titles=None))
    take = lambda: stream.run_available(stream.capture_stream(spark, source), stream.append_observations(target), checkpoint)
    take()
    put(spark, source + "/a", capture("https://a.id/9", day=-40), capture("https://a.id/8", result="blocked"))
    take()
    got = stream.read_observations(spark, target)
    want = parse_captures(read_captures(spark, source))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sorted((r.registry_source_id, r.title) for r in got.select("registry_source_id", "title").collect()) == sorted(
        [(read_captures(spark, source + "/a").first().registry_source_id, t) for t in ("Welder", "Cook", "Welder")] + [("board", "Welder")])
    assert sorted((r.page_url, r.fetch_result) for r in stream.read_rejects(spark, target).collect()) == [("https://a.id/2", "network"), ("https://a.id/8", "blocked")]
    plan = stream.observations_and_rejects(read_captures(spark, source))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1  # both kinds come from one reading of a batch


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_seen_times_do_not_depend_on_order(spark, tmp_path, order):
    batches = [
        [("k1", 5), ("k1", 9), ("k2", 0)], [("k1", -300), ("k3", 1), (None, 4)], [("k2", 700), ("k2", 700), ("k3", None)], [("k1", 6)] * 40,
    ]
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for n in order:
        rows = [(k, None if d is None else AT + timedelta(days=d), i) for i, (k, d) in enumerate(batches[n])]
        spark.createDataFrame(rows, "k string, seen_at timestamp, i int").coalesce(1).write.mode("append").parquet(source)
        flow = spark.readStream.schema("k string, seen_at timestamp, i int").parquet(source)
        sightings.keep_sightings(flow, ["k"], target, checkpoint)
    got = {r.k: (r.first_seen_at, r.last_seen_at, r.sightings) for r in sightings.read_sightings(spark, ["k"], target).collect()}
    at = lambda d: (AT + timedelta(days=d)).astimezone().replace(tzinfo=None)
    assert got == {"k1": (at(-300), at(9), 43), "k2": (at(0), at(700), 3), "k3": (at(1), at(1), 2), None: (at(4), at(4), 1)}
    # The forty sightings of one key went to several states, and each batch wrote its own keys only.
    states = spark.read.parquet(target)
    assert states.filter("k = 'k1'").select("slice").distinct().count() > 4
    assert states.filter("k = 'k3'").count() <= 2 and states.groupBy("batch").agg(F.count("*")).count() == 4


def test_seen_times_are_a_streaming_aggregate_of_every_file(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(4000).selectExpr("id % 500 as k", "timestamp_seconds(id) as seen_at")
    rows.repartition(8).write.parquet(source)
    flow = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(source)
    plan = sightings.sightings(flow, ["k"])._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan  # no Python call per key
    sightings.keep_sightings(flow, ["k"], str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sightings.read_sightings(spark, ["k"], str(tmp_path / "out"))
    want = rows.groupBy("k").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("sightings"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
