"""Queries that write tables of the lake and read them back, and rows of the publishing side."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postlake import schemas
from postlake.catalog.base import COMPARABLE, JOBS, MIDPOINT, SOURCES, query
from postlake.functions.postings import identifier_text
from postlake.operators import market, merge, quality
from postlake.plans import gold
from postlake.rules.sites import ARCHIVE_SOURCE
from postlake.rules.words import IMPLAUSIBLE_PAY_TEXT, TEMPLATE_PAY_TEXT
from postlake.session import checkpoint_dir
from postlake.sources import feeds, intake, lake, publish


def _folder(t, what: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# Pages as stored captures; pages of .org hosts come from a licensed import.
CAPTURES = """
select 'c1' as crawl, url, regexp_extract(url, '://([^/?#]+)', 1) as domain, cast(null as timestamp) as index_fetch_time,
       concat('page:', cast(page_id as @string)) as content_digest, cast(null as @string) as warc_filename,
       cast(page_id as bigint) as warc_record_offset, cast(length(html) as bigint) as warc_record_length,
       timestamp '2024-01-01 00:00:00' + interval '1' hour * cast(page_id as int) as captured_at, 200 as http_status,
       case when length(html) > 2000 then 'ok' else 'not_html' end as fetch_result, 0 as jobposting_count, 0 as malformed_jsonld,
       cast(null as @string) as postings_json, cast(null as timestamp) as fetched_at, 'v1' as connector_version
from {pages}
"""
_IMPORTED = "domain like '%.org'"


def _stored_captures(t, root: str):
    captures = t.view(CAPTURES)
    lake.write_parquet(captures.filter(f"not ({_IMPORTED})"), f"{root}/crawl=c1", sort_by=["domain", "url"])
    lake.write_parquet(captures.filter(_IMPORTED), f"{root}/imports/org-board/crawl=c1", sort_by=["domain", "url"])
    return lake.read_captures(t.spark, root)


@query("captures_read_back", f"""
    select case when {_IMPORTED} then 'org-board' else '{ARCHIVE_SOURCE}' end as registry_source_id, fetch_result, count(*) as captures,
           min(url) as first_url, max(captured_at) as newest, cast(sum(warc_record_length) as bigint) as bytes
    from c group by 1, 2""", c=CAPTURES)
def _(t):
    """Captures written as sorted zstd files below two sources' folders; the source comes from the path."""
    rows = _stored_captures(t, _folder(t, "captures"))
    return rows.filter(F.col("bronze_file").isNotNull()).groupBy("registry_source_id", "fetch_result").agg(
        F.count("*").alias("captures"), F.min("url").alias("first_url"), F.max("captured_at").alias("newest"), F.sum("warc_record_length").alias("bytes"))


@query("reobservations_read_back", """
    select crawl, url, content_digest, captured_at as index_fetch_time, domain from c where fetch_result = 'ok'""", c=CAPTURES)
def _(t):
    """Re-captures in folders of any depth and name; folder names add no columns."""
    root = _folder(t, "reobservations")
    rows = t.view(CAPTURES).filter("fetch_result = 'ok'").select("crawl", "url", "domain", F.col("captured_at").alias("index_fetch_time"), "content_digest")
    for k, where in enumerate((_IMPORTED, f"not ({_IMPORTED})")):
        lake.write_parquet(rows.filter(where), f"{root}/year=2024/part={k}/deep")
    found = lake.read_reobservations(t.spark, root)
    return schemas.required_columns(found, ("crawl", "url", "content_digest")).select("crawl", "url", "content_digest", "index_fetch_time", "domain")


@query("intake_of_new_files", f"""
    with m as (select case when {_IMPORTED} then 'org-board' else '{ARCHIVE_SOURCE}' end as registry_source_id, c.* from c)
    select registry_source_id, count(*) as captures, count(distinct domain) as domains from m where not ({_IMPORTED}) group by 1
    union all select 'again under another version', count(*), count(distinct domain) from m""", c=CAPTURES)
def _(t):
    """A manifest of one source's files: only the other source's are new, until the parser's version changes."""
    captures = _stored_captures(t, _folder(t, "intake"))
    manifest = intake.manifest_rows(captures.filter("registry_source_id = 'org-board'"))
    counts = F.count("*").alias("captures"), F.count_distinct("domain").alias("domains")
    fresh = intake.new_files(captures, manifest).groupBy("registry_source_id").agg(*counts)
    again = intake.new_files(captures, manifest, "another").agg(*counts).select(F.lit("again under another version").alias("registry_source_id"), "*")
    return fresh.unionByName(again)


@query("run_log_read_back", """
    select event_type, count(*) as records, sum(value) as total from events group by event_type
    union all select 'report', count(*), sum(value) from events""")
def _(t):
    """A report file and a log that each run appends one line to."""
    root = _folder(t, "run-log")
    sizes = F.count("*").alias("records"), F.round(F.sum("value"), 6).alias("total")
    runs = t.events.groupBy("event_type").agg(*sizes)
    for name in ("click", "error", "purchase", "signup", "view"):
        lake.append_run_log(runs.filter(F.col("event_type") == name), f"{root}/runs")
    lake.write_report(t.events.agg(*sizes).select(F.lit("report").alias("event_type"), "*"), f"{root}/report")
    rows = t.spark.read.schema("event_type string, records bigint, total double").json([f"{root}/runs", f"{root}/report"])
    return rows


@query("csv_read_back", """
    select cast(id as varchar) as id, title, city, cast(to_json(source_tags) as varchar) as source_tags, cast(is_assumed as varchar) as is_assumed
    from (select *, salary_period_assumed as is_assumed from jobs)""", jobs=JOBS)
def _(t):
    """Jobs as CSV with a header; lists are their JSON text, missing values empty."""
    root = _folder(t, "csv")
    lake.write_csv(t.view(JOBS).select("id", "title", "city", "source_tags", F.col("salary_period_assumed").alias("is_assumed")), root)
    return t.spark.read.option("header", True).csv(root)


@query("card_snapshot_jobs", """
    select p_name as title, p_name as company_name, p_type as location_text, p_type as employment_type_text,
           string_split(p_brand || ' | ' || p_type, ' | ') as tags, 'content_fingerprint' as source_key_kind, p_name as raw_company
    from part""")
def _(t):
    """Parts as a card snapshot: a CSV file with a byte-order mark before its header."""
    root = _folder(t, "cards")
    p = t.part
    cards = p.select(
        F.col("p_name").alias("﻿job_title"), F.col("p_name").alias("company_name"), F.col("p_type").alias("location"), F.col("p_retailprice").cast("string").alias("salary_range"),
        F.col("p_type").alias("job_type"), F.lit("").alias("experience_level"), F.lit("").alias("education_req"),
        F.concat_ws(" | ", "p_brand", "p_type").alias("job_requirements"), F.lit("Kemarin").alias("posted_date"), F.lit("x").alias("source_platform"))
    cards.write.option("header", True).csv(root)
    rows = feeds.snapshot_source_jobs(feeds.read_snapshot_csv(t.spark, root))
    return rows.select("title", "company_name", "location_text", "employment_type_text", "tags", "source_key_kind", F.col("raw_fields")["company_name"].alias("raw_company"))


# Orders as canonical vacancies with trusted, template and implausible pay, and doubtful deadlines.
VACANCIES = """
select cast(o.o_orderkey as @string) as vacancy_id, r.r_name as registry_source_id, o.o_orderpriority as title, c.c_name as organization,
       concat('https://v.example/', cast(o.o_orderkey as @string)) as canonical_url, cast(o.o_orderdate as timestamp) as first_seen_at,
       cast(o.o_orderdate as timestamp) + interval '9' day as last_seen_at, o.o_orderstatus = 'F' as salary_reliable,
       case o.o_orderstatus when 'O' then 'SITE_TEMPLATE' when 'P' then 'BELOW_MONTHLY_FLOOR' end as salary_unreliable_reason,
       o.o_totalprice > 100000 as valid_through_reliable, cast(floor(o.o_totalprice) as bigint) as salary_monthly_min,
       cast(floor(o.o_totalprice) + 1000 as bigint) as salary_monthly_max,
       case when c.c_acctbal > 0 then cast(o.o_orderdate as date) end as valid_through, n.n_name as city, r.r_name as province,
       @list(n.n_name @end as sites, 1 as source_records, false as city_templated, o.o_orderpriority as source_title,
       'a.example' as source_domain, 'p1' as parser_version, 'FULL_TIME' as employment_type_raw,
       case when c.c_acctbal > 5000 then 'REMOTE' else 'UNKNOWN' end as work_arrangement,
       case when c.c_acctbal > 2000 then 2 end as experience_min_years, 'BACHELOR' as education_level, cast(o.o_orderdate as date) as date_posted,
       'DISCLOSED' as salary_status, o.o_orderstatus = 'O' as salary_template_site, c.c_mktsegment as employment_type,
       case when c.c_acctbal > 0 then concat('id-', c.c_name) end as source_identifier, cast(length(o.o_orderpriority) * 15 as bigint) as description_length
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
     join {region} r on n.n_regionkey = r.r_regionkey
"""


@query("vacancies_to_publish", f"""
    select vacancy_id as source_key, title, organization as company_name, city || ', ' || province as location_text,
           case when salary_reliable then salary_monthly_min end as pay_minimum, case when salary_reliable then 'MONTH' end as pay_period,
           case when not salary_reliable then case salary_unreliable_reason when 'SITE_TEMPLATE' then '{TEMPLATE_PAY_TEXT}'
                when 'BELOW_MONTHLY_FLOOR' then '{IMPLAUSIBLE_PAY_TEXT}' end end as salary_text,
           case when work_arrangement = 'REMOTE' then 'remote' end as work_arrangement_text,
           case when experience_min_years is not null then 'minimal 2 tahun' end as experience_text, 'Sarjana (S1)' as education_text,
           case when valid_through_reliable then cast(valid_through as timestamp) + interval '60' second * 1019 + interval '59' second end as expires_at,
           valid_through is not null and not valid_through_reliable as deadline_unreliable
    from v where registry_source_id = 'ASIA'""", v=VACANCIES)
def _(t):
    """Vacancies of one source as records to publish: untrusted pay becomes a text, a doubtful deadline stays in the raw fields."""
    rows = publish.vacancy_source_jobs(t.view(VACANCIES), "ASIA")
    raw = F.col("raw_fields")
    return rows.select(
        "source_key", "title", "company_name", "location_text", F.col("structured_salary.minimum").alias("pay_minimum"),
        F.col("structured_salary.period").alias("pay_period"), "salary_text", "work_arrangement_text", "experience_text", "education_text", "expires_at",
        (raw["valid_through_unreliable"] == "true").alias("deadline_unreliable"))


@query("archive_evidence", """
    select vacancy_id as source_key, case when salary_reliable then 1 end as pages, case when salary_reliable then city end as first_site,
           case when salary_reliable then valid_through is not null and not valid_through_reliable end as deadline_unreliable,
           case when salary_reliable then title end as source_title
    from v where registry_source_id = 'ASIA'""", v=VACANCIES)
def _(t):
    """What the archive saw of published vacancies; rows of other sources, here those with untrusted pay, carry no such fields."""
    rows = publish.vacancy_source_jobs(t.view(VACANCIES), "ASIA")
    raw = F.when(F.col("structured_salary").isNotNull(), F.col("raw_fields")).otherwise(F.create_map(F.lit("key"), F.col("source_key")))
    seen = rows.select("source_key", market.archive_evidence(raw).alias("e"))
    return seen.select("source_key", "e.pages", F.get("e.sites", F.lit(0)).alias("first_site"), "e.deadline_unreliable", "e.source_title")


@query("salary_overall", f"""
    select count(*) as vacancies, count(*) filter (where salary_status = 'DISCLOSED') as disclosed, count(salary_monthly_min) as disclosed_monthly_idr,
           count(*) filter (where salary_template_site) as on_salary_template_sites, count(*) filter (where salary_reliable and {MIDPOINT} >= 500000) as n,
           {', '.join(f"round(quantile_cont({MIDPOINT}, {p / 100}) filter (where salary_reliable and {MIDPOINT} >= 500000), 2) as p{p}" for p in (10, 25, 50, 75, 90))}
    from (select *, {COMPARABLE} as salary_reliable, employment_type = '5-LOW' as salary_template_site from jobs)""", jobs=JOBS)
def _(t):
    """One row over all vacancies: disclosure, template sites and percentiles of trusted pay."""
    jobs = t.view(JOBS).withColumns({"salary_reliable": F.expr(COMPARABLE), "salary_template_site": F.col("employment_type") == "5-LOW"})
    out = gold.salary_overall(jobs)
    return out.select(*[c for c in out.columns if c != "percentiles"], *[
        F.round(F.get("percentiles", F.lit(k)), 2).alias(f"p{p}") for k, p in enumerate((10, 25, 50, 75, 90))])


_CHECKS = {
    "province": "province is not null", "city": "city is not null", "date_posted": "date_posted is not null", "valid_through": "valid_through is not null",
    "valid_through_reliable": "valid_through_reliable", "salary_disclosed": "salary_status = 'DISCLOSED'",
    "salary_reliable_monthly_idr": f"salary_reliable and {MIDPOINT} >= 500000", "description_100_chars": "description_length >= 100",
    "canonical_url": "canonical_url is not null", "source_identifier": "source_identifier is not null", "employment_type": "employment_type <> 'UNKNOWN'",
    "education": "education_level <> 'UNKNOWN'",
}


@query("completeness_of_vacancies", " union all ".join(
    f"select '{name}' as field, round(avg(case when {check} then 1.0 else 0.0 end), 4) as share from v" for name, check in _CHECKS.items()), v=VACANCIES)
def _(t):
    """The twelve completeness checks in one pass."""
    return quality.shares(t.view(VACANCIES), quality.completeness_checks())


DECISIONS = """
select n.n_name as id, 'ops' as actor, case when n.n_nationkey < 10 then 'set_status' when n.n_nationkey < 20 then 'pause' else 'resume' end as action,
       case when n.n_nationkey < 10 then 'REVOKED' end as status, case when n.n_nationkey <> 3 then 'letter received' end as reason,
       case when n.n_nationkey <> 4 then 'https://evidence.example/' end as evidence_url
from {nation} n
"""


@query("registry_decisions_applied", """
    with d as (
        select s.id, s.is_paused, s.permission_status, d.action, d.status,
               case when d.action = 'set_status' and (d.reason is null or d.evidence_url is null) then 'a permission change needs a reason and an evidence URL'
                    when d.action = 'resume' and s.permission_status not in ('APPROVED', 'APPROVED_WITH_CONDITIONS') then 'record an approval before resuming' end as refusal
        from sources s join decisions d using (id))
    select id, case action when 'set_status' then 'source.permission_changed' when 'pause' then 'source.paused' else 'source.resumed' end as action, refusal,
           case when action = 'set_status' and refusal is null then status else permission_status end as permission_status,
           case when refusal is not null then is_paused when action = 'pause' then true when action = 'resume' then false else is_paused end as is_paused
    from d""", sources=SOURCES, decisions=DECISIONS)
def _(t):
    """Permission changes, pauses and resumptions with their refusals, and the registry after them."""
    table, audit = merge.apply_decisions(t.view(SOURCES), t.view(DECISIONS), "2000-06-01 00:00:00")
    return audit.select(F.col("entity_id").alias("id"), "action", "refusal").join(table.select("id", "permission_status", "is_paused"), "id")


_SHAPE = """
case p_size % 6 when 0 then '"' || p_brand || '"' when 1 then cast(p_partkey as string) when 2 then '{"@type":"PropertyValue","name":"x","value":"' || p_name || '"}'
     when 3 then '{"@value":"' || p_brand || '"}' when 4 then '[null,{"name":"only"},"' || p_name || '"]' else 'true' end
"""


@query("posting_identifiers", """
    select p_partkey, case p_size % 6 when 0 then p_brand when 1 then cast(p_partkey as varchar) when 2 then p_name when 3 then p_brand when 4 then p_name end as identifier
    from part""")
def _(t):
    """Identifiers as strings, numbers, property values and lists; of other shapes there is none."""
    shapes = t.part.withColumn("v", F.try_parse_json(F.expr(_SHAPE)))
    return shapes.select("p_partkey", identifier_text("v").alias("identifier"))
