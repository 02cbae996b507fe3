import gzip
import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postlake import catalog, schemas
from postlake.plans.publish import JOB_VALUES, import_source
from postlake.plans.silver import capture_pages
from postlake.sources import feeds, intake, lake, publish, synthetic, warc
from postlake.streaming import jobs as stream

AT = datetime(2026, 10, 1, tzinfo=timezone.utc)


def record(kind, block, *more):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"Content-Length: %d" % len(block), *more]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(url, body, *fields):
    http = b"\r\n".join([b"HTTP/1.1 200 OK", *fields]) + b"\r\n\r\n" + body
    return record(b"response", http, b"WARC-Target-URI: " + url, b"WARC-Date: 2031-02-03T04:05:06Z")


POSTING = b'<script type="application/ld+json">[{"@graph":[{"@type":["Thing","http://schema.org/JobPosting"],"title":"Welder"}]}]</script>'


def archive(tmp_path, spark, **files):
    for name, data in files.items():
        path = tmp_path / name.replace("__", "/")
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    options = {"recursiveFileLookup": "true"}
    rows = warc.split_records(spark.read.options(**options).format("binaryFile").load(str(tmp_path)).select("path", "content"))
    return sorted(rows.collect(), key=lambda r: (r.warc_filename, r.warc_record_offset, r.url or ""))


def test_plain_archives_hold_many_records(spark, tmp_path):
    records = [response(b"https://www.one.test/a", POSTING), record(b"request", b"GET / HTTP/1.1\r\n\r\n"), response(b"https://two.test/WARC/", b"WARC/1.1 in a body")]
    rows = archive(tmp_path, spark, plain=b"".join(records))
    assert [(r.url, r.domain, r.reject_reason) for r in rows] == [
        ("https://www.one.test/a", "one.test", None), (None, None, "not_a_response_record"), ("https://two.test/WARC/", "two.test", None)]
    assert [r.warc_record_offset for r in rows] == [0, len(records[0]), len(records[0]) + len(records[1])]
    assert rows[2].body == "WARC/1.1 in a body" and rows[0].http_status == 200


def test_damage_becomes_a_reason(spark, tmp_path):
    good, late = gzip.compress(response(b"https://a.test/", b"x")), gzip.compress(response(b"https://b.test/", b"y"))
    broken = bytearray(late)
    broken[14:30] = b"\xff" * 16
    rows = archive(tmp_path, spark, cut=good + late[:-12], broken=bytes(broken) + good, short=response(b"https://c.test/", b"z")[:-9])
    assert [(r.warc_filename.rpartition("/")[2], r.reject_reason) for r in rows] == [
        ("broken", "damaged_member"), ("broken", None), ("cut", None), ("cut", "truncated_member"), ("short", "truncated_record")]


def test_equal_file_names_and_coded_bodies(spark, tmp_path):
    chunked = b"4\r\nwiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    rows = archive(
        tmp_path, spark, one__x=response(b"https://a.test/", chunked, b"Transfer-Encoding: chunked"),
        two__x=response(b"https://a.test/", gzip.compress(b"wikipedia"), b"Content-Encoding: gzip") + response(b"https://a.test/", b"no gzip", b"Content-Encoding: gzip"))
    assert len({r.warc_filename for r in rows}) == 2
    assert [r.body for r in rows] == ["wikipedia", "wikipedia", None] and rows[2].reject_reason == "damaged_body"
    assert rows[0].content_digest == rows[1].content_digest


def test_archives_go_through_to_captures(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(response(b"https://a.test/1", POSTING)) + gzip.compress(record(b"metadata", b"")))
    pages = capture_pages(warc.read_warc(spark, str(tmp_path)), "c1").orderBy("warc_record_offset").collect()
    assert [(p.jobposting_count, p.fetch_result, p.domain) for p in pages] == [(1, "ok", "a.test"), (0, "not_a_response_record", None)]
    assert json.loads(pages[0].postings_json)[0]["title"] == "Welder" and pages[0].content_digest


def test_jsonl_import(spark, tmp_path):
    base = {"title": "Data Analyst", "@type": "JobPosting"}
    lines = [json.dumps(base | {"url": "https://provider.example/1", "captured_at": "2026-09-02T00:00:00Z"}),
             json.dumps(base | {"url": "not-a-url", "captured_at": "2026-09-02T00:00:00Z"}), json.dumps(base | {"url": "https://provider.example/2"}), "[1, 2]", ""]
    path = tmp_path / "export.jsonl"
    path.write_text("\n".join(lines))
    accepted, rejects = feeds.read_jsonl(spark, str(path), "licensed")
    row = accepted.first()
    assert (row.domain, row.crawl, json.loads(row.postings_json)) == ("provider.example", "import:licensed", [base])
    assert rejects.count() == 3
    assert feeds.read_jsonl(spark, str(path), "licensed", accepted)[0].count() == 0
    s = feeds.import_summary(feeds.validate_lines(spark.read.text(str(path)), "licensed")).first()
    assert (s.lines, s.imported, s.rejected, len(s.rejection_samples)) == (4, 1, 3, 3)


CARDS = [
    ("Data Engineer", "PT Contoh", "Jakarta Selatan,DKI Jakarta", "Rp 8 jt-12 jt", "Penuh Waktu", "1–3 tahun", "Minimal Sarjana (S1)", "SQL | +4", "3 hari yang lalu", "x"),
    ("C++ Software Engineer", "CV Uji", "Kab. Buleleng,Bali", "Gaji Tidak Ditampilkan", "Kontrak", "3–5 tahun", "Minimal Diploma", "+2 | C++", "UrgentKemarin", "x"),
    ("UI/UX Designer Intern", "Studio", "Yogyakarta,DI Yogyakarta", "Rp 1 jt-1,5 jt", "Magang", "Not Specified", "Minimal SMA/SMK", "+5 | Remote/Dari rumah", "13 jam yang lalu", "x"),
    ("", "PT Kosong", "Surabaya,Jawa Timur", "Rp 5 jt-6 jt", "Penuh Waktu", "1–3 tahun", "Minimal SD", "+1", "Kemarin", "x"),
]


@pytest.fixture(scope="module")
def empty(spark):
    jobs = "id string, primary_source_id string, fingerprint string, normalization_version string, first_seen_at timestamp, last_seen_at timestamp"
    records = "source_id string, source_key string, job_id string, match_rule string, content_hash string, normalization_version string, first_seen_at timestamp, last_seen_at timestamp"
    jobs_df = spark.createDataFrame([], jobs)
    typed = {"salary_min": "bigint", "salary_max": "bigint", "salary_monthly_min": "bigint", "salary_monthly_max": "bigint", "hidden_tag_count": "int", "posted_age_days": "int",
             "source_tags": "array<string>", "quality_flags": "array<string>", "is_urgent": "boolean", "salary_period_assumed": "boolean", "published_at": "timestamp", "expires_at": "timestamp"}
    return jobs_df.withColumns({v: F.lit(None).cast(typed.get(v, "string")) for v in JOB_VALUES}), spark.createDataFrame([], records)


def test_snapshot_csv_import_is_idempotent(spark, tmp_path, empty):
    import csv

    path = tmp_path / "cards.csv"
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([schemas.SNAPSHOT_COLUMNS, *CARDS])
    rows = feeds.snapshot_source_jobs(feeds.read_snapshot_csv(spark, str(path)))
    run = import_source(*empty, rows, "cards", AT, "IDR", "MONTH")
    jobs, records = run.jobs.cache(), run.records.cache()
    assert {r.outcome for r in records.collect()} == {"created"} and records.count() == 3
    assert [r.reject_reason for r in run.rejects.collect()] == ["record has no job title"]
    by = {j.title: j for j in jobs.collect()}
    assert (by["Data Engineer"].role_family, by["Data Engineer"].salary_monthly_max, by["Data Engineer"].source_tags) == ("DATA_ANALYTICS", 12_000_000, ["SQL"])
    assert "SALARY_PERIOD_ASSUMED" in by["Data Engineer"].quality_flags and "data engineer" in by["Data Engineer"].search_text
    hidden = by["C++ Software Engineer"]
    assert (hidden.salary_status, hidden.salary_min, hidden.is_urgent, hidden.posted_age_days, hidden.hidden_tag_count, hidden.city) == ("NOT_DISCLOSED", None, True, 1, 2, "Kabupaten Buleleng")
    assert (by["UI/UX Designer Intern"].work_arrangement, by["UI/UX Designer Intern"].city) == ("REMOTE", "Yogyakarta")
    again = import_source(jobs.drop("outcome"), records.drop("outcome"), rows, "cards", AT - timedelta(days=30), "IDR", "MONTH")
    assert {r.outcome for r in again.records.collect()} == {"unchanged"}
    job = again.jobs.filter("title = 'Data Engineer'").first()
    assert job.first_seen_at < job.last_seen_at
    stopped = import_source(jobs.drop("outcome"), records.drop("outcome"), rows, "cards", AT, replaces_snapshot=True)
    assert not stopped.published
    with pytest.raises(ValueError):
        schemas.required_columns(spark.range(1), schemas.SNAPSHOT_COLUMNS)


def test_cross_source_match_and_retirement(spark, empty):
    def batch(*rows):
        return spark.createDataFrame([(k, t, "PT Contoh", "Bandung,Jawa Barat", {"k": k, "t": t}) for k, t in rows],
                                     "source_key string, title string, company_name string, location_text string, raw_fields map<string,string>")

    a = import_source(*empty, batch(("a-1", "Data Engineer"), ("a-2", "Kasir")), "a", AT)
    jobs, records = a.jobs.drop("outcome").cache(), a.records.drop("outcome").cache()
    b = import_source(jobs, records, batch(("b-7", "DATA ENGINEER")), "b", AT)
    assert b.records.filter("source_id = 'b'").first().match_rule == "cross_source_fingerprint"
    bj, br = b.jobs.drop("outcome").cache(), b.records.drop("outcome").cache()
    assert bj.count() == 2 and bj.filter("title = 'Data Engineer'").count() == 1
    c = import_source(bj, br, batch(("a-3", "Sopir")), "a", AT, replaces_snapshot=True)
    assert {j.title for j in c.jobs.collect()} == {"Data Engineer", "Sopir"}
    assert {r.source_key for r in c.records.collect()} == {"a-3", "b-7"}
    changed = import_source(jobs, records, spark.createDataFrame(
        [("a-1", "Senior Data Engineer", {"k": "a-1", "t": "new"})], "source_key string, title string, raw_fields map<string,string>"), "a", AT)
    assert {(j.title, j.outcome) for j in changed.jobs.collect()} == {("Senior Data Engineer", "updated"), ("Kasir", "kept")}


def test_publish_projection(spark):
    rows = [("v1", "s", "Admin", "PT A", "https://a.id/1", AT, AT, True, None, True, 4_000_000, 5_000_000, "2026-10-20", "Bandung"),
            ("v2", "s", "Kasir", "PT B", "https://a.id/2", AT, AT, False, "SITE_TEMPLATE", False, 2, 2, "2026-10-20", None), ("v3", "other", "X", "PT C", "u", AT, AT, True, None, True, 1, 1, None, None)]
    v = spark.createDataFrame(rows, "vacancy_id string, registry_source_id string, title string, organization string, canonical_url string, first_seen_at timestamp, last_seen_at timestamp, "
                              "salary_reliable boolean, salary_unreliable_reason string, valid_through_reliable boolean, salary_monthly_min bigint, salary_monthly_max bigint, valid_through string, city string")
    v = v.withColumns({"valid_through": F.to_date("valid_through"), "province": F.lit("Jawa Barat"), "sites": F.array(F.lit("a.id")), "source_records": F.lit(1), "city_templated": F.lit(False),
                       "source_title": F.col("title"), "source_domain": F.lit("gaji.co.id"), "parser_version": F.lit("p"), "employment_type_raw": F.lit("FULL_TIME"), "work_arrangement": F.lit("REMOTE"),
                       "experience_min_years": F.lit(2), "education_level": F.lit("BACHELOR"), "date_posted": F.to_date(F.lit("2026-09-01"))})
    one, two = publish.vacancy_source_jobs(v, "s").orderBy("source_key").collect()
    assert (one.structured_salary.minimum, one.salary_text, one.location_text) == (4_000_000, None, "Bandung, Jawa Barat")
    assert one.expires_at.replace(tzinfo=timezone.utc) == datetime(2026, 10, 20, 16, 59, 59, tzinfo=timezone.utc)
    assert two.structured_salary is None and not any(ch.isdigit() for ch in two.salary_text) and two.expires_at is None
    assert two.raw_fields["valid_through_unreliable"] == "true" and two.raw_fields["source_valid_through"] == "2026-10-20"
    assert one.raw_fields["aggregator_site"] == "true"


def test_files_manifest_and_sinks(spark, tmp_path):
    rows = [("c", f"https://a.id/{i}", "a.id", AT, "d", None, None, None, AT, 200, "ok", 1, 0, "[]", AT, "v") for i in range(3)]
    df = spark.createDataFrame(rows, schemas.CAPTURE)
    lake.write_parquet(df, str(tmp_path / "captures/crawl=c"))
    lake.write_parquet(df.limit(1), str(tmp_path / "imports/feed-x"))
    read = lake.read_captures(spark, str(tmp_path / "captures"), str(tmp_path / "imports")).cache()
    assert {r.registry_source_id: r["count"] for r in read.groupBy("registry_source_id").count().collect()} == {"commoncrawl-jobposting": 3, "feed-x": 1}
    manifest = intake.manifest_rows(read)
    assert intake.new_files(read, manifest).count() == 0
    assert intake.new_files(read, manifest.withColumn("version", F.lit("older"))).count() == 4
    lake.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    lake.append_run_log(df.agg(F.count("*").alias("n")), str(tmp_path / "log"))
    lake.append_run_log(df.agg(F.count("*").alias("n")), str(tmp_path / "log"))
    lake.write_csv(df.select("url", F.array("domain").alias("d")), str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_synthetic_records_do_not_depend_on_partitions(spark):
    a = synthetic.source_records(spark, 500).cache()
    assert a.count() == 500 and a.filter("source_record_key like 'synthetic-copy-%'").count() == 100


def test_streams(spark, tmp_path):
    def put(batch, rows):
        spark.createDataFrame(rows, schemas.CAPTURE).coalesce(1).write.parquet(str(tmp_path / f"in/b{batch}"))

    def row(url, result="ok", day=0):
        return ("c", url, "a.id", AT, "d", None, None, None, AT + timedelta(days=day), 200, result, 1, 0, "[]", AT, "v")

    put(1, [row("u1"), row("u2", "network")])
    source, target, bad, seen = (str(tmp_path / n) for n in ("in", "out", "bad", "seen"))
    folder = stream.version_folder(str(tmp_path / "ck"))
    write = stream.append_parsed(lambda d: d.select("url", "bronze_file"), target, bad)
    stream.run_available(stream.capture_stream(spark, source), write, folder)
    put(2, [row("u3"), row("u1", day=-5)])
    stream.run_available(stream.capture_stream(spark, source), write, folder)
    assert spark.read.parquet(target).count() == 3 and spark.read.parquet(bad).count() == 1
    sightings = stream.capture_stream(spark, source).withColumn("seen_at", F.col("captured_at"))
    stream.run_available(sightings, stream.widen_seen(["url"], seen), folder + "-seen")
    u1 = stream.read_seen(spark, ["url"], seen).filter("url = 'u1'").first()
    assert u1.sightings == 2 and u1.last_seen_at - u1.first_seen_at == timedelta(days=5)
    fresh = stream.new_contents(stream.capture_stream(spark, source))
    query = fresh.writeStream.format("memory").queryName("fresh").option("checkpointLocation", folder + "-new").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("fresh").count() == 3


def test_new_contents_come_once_however_late_or_far_apart(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def put(batch, *captures):
        rows = [("c", url, "a.id", AT, digest, None, None, None, AT + timedelta(days=day), 200, "ok", 1, 0, "[]", AT, "v") for url, digest, day in captures]
        spark.createDataFrame(rows, schemas.CAPTURE).coalesce(1).write.parquet(f"{source}/b{batch}")
        fresh = stream.new_contents(stream.capture_stream(spark, source))
        fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "ck")).trigger(
            availableNow=True).start().awaitTermination()
        return sorted((r.url, r.content_digest) for r in spark.read.parquet(target).collect())

    assert put(1, ("u1", "d", 0), ("u1", "d", 1)) == [("u1", "d")]
    assert put(2, ("u2", "d", 400)) == [("u1", "d"), ("u2", "d")]
    assert put(3, ("u3", "d", -300), ("u1", "d", -300), ("u1", "e", 0)) == [("u1", "d"), ("u1", "e"), ("u2", "d"), ("u3", "d")]
    assert put(4, ("u1", "d", 900), ("u2", "d", 900)) == [("u1", "d"), ("u1", "e"), ("u2", "d"), ("u3", "d")]


def test_archived_pages_are_read_from_files_of_many_records(spark, monkeypatch, tmp_path):
    pages = [(i, f"https://www.p{i % 3}.test/", f"<p>é{i}</p>\r\n\r\nWARC/1.1") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    files = []
    monkeypatch.setattr(warc, "read_warc", lambda spark, path, read=warc.read_warc: files.append(read(spark, path)) or files[0])
    rows = catalog.QUERIES["archived_pages"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(i, u, f"p{i % 3}.test", hashlib.sha1(h.encode()).hexdigest()) for i, u, h in pages]
    names = [r.warc_filename for r in files[0].select("warc_filename").distinct().collect()]
    assert sorted(n.endswith(".gz") for n in names) == [False, True]
