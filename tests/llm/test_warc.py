"""WARC round trips with payloads that hold records themselves, on tiny splits."""

import hashlib

import numpy as np
import pytest

from postlake.llm import warc
from postlake.llm.stage import shared_path

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")


def round_trip(spark, rows):
    path = shared_path(spark, "test-warc")
    warc.write_warc(pages(spark, rows).repartition(3), path)
    return path, warc.resolve_revisits(warc.read_warc(spark, path)).collect()


def test_payloads_with_records_inside_come_back_whole(spark, small_splits):
    rows = [(i, f"http://a/{i}", "x" * (i * 37 % 900) + INNER * (i % 4 if i % 3 == 0 else 0) + (f"ü{i}" if i % 5 else "")) for i in range(120)]
    rows += [(500, None, None), (501, "u\r\nWARC/1.1", "y" * 1500), (502, "v", "y" * 1500), (503, "", "y" * 1500), (503, "", "y" * 1500),
             (504, "", "WARC/1.1\r\n"), (None, "q", INNER * 60), (505, "q", INNER * 60), (506, "", "y" * 999), (507, "", "y" * 999), (508, "", "é" * 500), (509, "", "é" * 500)]
    _, got = round_trip(spark, rows)
    want = sorted((str(a), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for a, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(501, 503), (502, 503), (508, 509)}
    assert all(r.refers_to is None for r in got if r.record_type == "response")


def test_the_library_of_records_is_the_files_own_bytes(spark):
    """Without Spark: following lengths from the start of each part file gives the same records."""
    path, got = round_trip(spark, [(i, "u", INNER * i) for i in range(9)])
    found = []
    for (file, data) in [(r.path, bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect()]:
        at = 0
        while at < len(data):
            assert data[at : at + 10] == warc.MAGIC, file
            record = warc.parse_record(data[at + 10 :])
            block = data[at + 10 + record["start"] :][: record["length"]]
            found.append(hashlib.sha1(warc.payload_of(block, record["head"]["content-type"])).hexdigest())
            at += record["span"]
    assert sorted(found) == sorted(r.payload_digest for r in got)


def test_no_pages(spark):
    assert round_trip(spark, [])[1] == []


def test_a_cut_file_is_an_error(spark):
    path = shared_path(spark, "test-cut")
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort",)], "value string").write.option("lineSep", "\n").text(path)
    with pytest.raises(Exception, match="chain of records breaks"):
        warc.read_warc(spark, path).collect()


def test_pointer_doubling_follows_only_the_first_chain():
    draw = np.random.default_rng(2)
    for _ in range(200):
        starts = np.unique(np.append(draw.integers(1, 500, 40), 0))
        nexts = starts + draw.integers(1, 40, len(starts))
        reached, at = set(), 0
        while at in starts:
            reached.add(int(at))
            at = int(nexts[np.searchsorted(starts, at)])
        assert set(starts[warc.jump_pointers(starts, nexts)].tolist()) == reached


def test_slots_hold_every_digest_that_occurs_twice(spark, monkeypatch):
    rows = [(f"d{k % 50 if k < 100 else k}",) for k in range(400)]
    digests = spark.createDataFrame(rows, "digest string")
    marked = digests.distinct().withColumn("m", warc.shares_slot(digests)).collect()
    twice = {f"d{k}" for k in range(50)}
    assert {r.digest for r in marked if r.m} >= twice and sum(r.m for r in marked) < 55  # a chance match at most
    monkeypatch.setattr(warc, "SLOTS", 8)  # a full filter lets all through and loses none
    assert {r.digest for r in digests.distinct().filter(warc.shares_slot(digests)).collect()} >= twice
