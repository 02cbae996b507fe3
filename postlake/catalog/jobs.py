"""Queries over orders seen as serving jobs: filters, search, market, salary, tags, quality."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import functions as F

from postlake.catalog.base import AS_OF, COMPARABLE, HOST, JOBS, LIFECYCLE, MIDPOINT, RUNS, SOURCES, query
from postlake.operators import breakdown as bd
from postlake.operators import market, merge, policy, quality, salary_stats, search, tags
from postlake.operators.filters import JobFilters, apply_filters, lifecycle
from postlake.operators.pay_rule import comparable_salary, monthly_idr_recorded, monthly_midpoint
from postlake.plans import gold, publish
from postlake.functions.urls import publisher_site, safe_link
from postlake.session import checkpoint_dir
from postlake.sources import versions

FREE = {"strict_codes": False}


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("filtered_jobs", f"""
    select id, province, cast(salary_monthly_max as bigint) as salary_monthly_max from jobs
    where contains(search_text, 'furniture') and contains(search_text, 'nation_1') and province in ('ASIA', 'EUROPE')
      and {COMPARABLE} and salary_monthly_max >= 4000000 and salary_monthly_min <= 12000000""", jobs=JOBS)
def _(t):
    f = JobFilters(q=" Furniture nation_1 ", province=("ASIA", "EUROPE"), salary_min=4_000_000, salary_max=12_000_000, **FREE)
    return apply_filters(t.view(JOBS), f).select("id", "province", "salary_monthly_max")


@query("tag_overlap_filter", "select id, city from jobs where list_has_any(source_tags, ['excel', 'python'])"
       " and work_arrangement in ('REMOTE', 'HYBRID')", jobs=JOBS)
def _(t):
    f = JobFilters(tag=("excel", "python"), work_arrangement=("REMOTE", "HYBRID"), **FREE)
    return apply_filters(t.view(JOBS), f).select("id", "city")


@query("lifecycle_labels", f"select {LIFECYCLE} as freshness, count(*) as jobs from jobs group by 1", jobs=JOBS)
def _(t):
    return t.view(JOBS).groupBy(lifecycle(AS_OF).alias("freshness")).agg(F.count("*").alias("jobs"))


@query("lifecycle_filter", f"select id from jobs where {LIFECYCLE} in ('EXPIRED_BY_SOURCE', 'POTENTIALLY_ACTIVE')", jobs=JOBS)
def _(t):
    f = JobFilters(freshness=("EXPIRED_BY_SOURCE", "POTENTIALLY_ACTIVE"))
    return apply_filters(t.view(JOBS), f, AS_OF).select("id")


@query("comparable_salary_rule", f"""
    select province, count(*) filter (where {COMPARABLE}) as comparable,
           count(*) filter (where salary_status = 'DISCLOSED' and salary_currency = 'IDR') as recorded,
           round(sum({MIDPOINT}) filter (where {COMPARABLE}), 1) as midpoint_sum
    from jobs group by province""", jobs=JOBS)
def _(t):
    ok = comparable_salary()
    return t.view(JOBS).groupBy("province").agg(
        F.count_if(ok).alias("comparable"), F.count_if(monthly_idr_recorded()).alias("recorded"),
        F.round(F.sum(F.when(ok, monthly_midpoint())), 1).alias("midpoint_sum"))


def _breakdown_sql(column, limit):
    return f"""
    with c as (select {column} as k, count(*) as n from jobs group by 1),
         s as (select sum(n) as total, count(*) as distinct_values from c),
         top as (select * from c order by n desc, k asc nulls last limit {limit})
    select k as key, coalesce(k, 'Tidak dicantumkan') as label, n as count, round(n / total, 6) as share,
           cast(total as bigint) as total, distinct_values,
           cast(total - (select sum(n) from top) as bigint) as other_count
    from top, s"""


for _dimension, _column, _limit in (("city", "city", 10), ("company", "company_name", 20), ("title", "title", 7)):
    @query(f"breakdown_by_{_dimension}", _breakdown_sql(_column, _limit), jobs=JOBS)
    def _(t, dimension=_dimension, limit=_limit):
        return rounded(bd.breakdown(t.view(JOBS), dimension, limit=limit), "share", digits=6)


@query("breakdown_by_source_filtered", """
    with c as (select primary_source_id as k, count(*) as n from jobs where salary_status = 'DISCLOSED' group by 1)
    select k as key, s.name as label, n as count from c join sources s on s.id = k order by n desc, k limit 15""",
       jobs=JOBS, sources=SOURCES)
def _(t):
    out = bd.breakdown(t.view(JOBS), "source", JobFilters(salary_disclosed=True), 15, sources=t.view(SOURCES))
    return out.select("key", "label", "count")


@query("filter_options", f"""
    with long as (
        select unnest([{{'d': 'province', 'k': province}}, {{'d': 'city', 'k': city}}, {{'d': 'role_family', 'k': role_family}},
            {{'d': 'employment_type', 'k': employment_type}}, {{'d': 'work_arrangement', 'k': work_arrangement}},
            {{'d': 'education', 'k': education_level}}, {{'d': 'experience', 'k': experience_band}},
            {{'d': 'source', 'k': primary_source_id}}, {{'d': 'freshness', 'k': {LIFECYCLE}}}]) as o from jobs)
    select o.d as dimension, o.k as key, count(*) as count from long where o.k is not null group by all""", jobs=JOBS)
def _(t):
    return bd.filter_options(t.view(JOBS), AS_OF)


@query("salary_filter_bounds", f"""
    select min(salary_monthly_min) as salary_monthly_from, max(salary_monthly_max) as salary_monthly_to
    from jobs where {COMPARABLE}""", jobs=JOBS)
def _(t):
    return bd.salary_bounds(t.view(JOBS))


@query("market_overview", f"""
    select count(*) as total_jobs, count(distinct lower(company_name)) as companies, count(distinct city) as cities,
           count(distinct province) as provinces, count(distinct primary_source_id) as sources_with_jobs,
           count(distinct {HOST}) as publisher_sites,
           count(*) filter (where salary_status = 'DISCLOSED') as salary_disclosed,
           count(*) filter (where work_arrangement in ('REMOTE', 'HYBRID')) as remote_or_hybrid,
           cast(min(last_seen_at) as date) as observed_from, cast(max(last_seen_at) as date) as observed_to,
           (select count(*) from lineitem where l_orderkey in
               (select id from jobs where province <> 'AFRICA' and province <> 'AMERICA')) as total_source_records
    from jobs where province <> 'AFRICA' and province <> 'AMERICA'""", jobs=JOBS)
def _(t):
    records = t.lineitem.select(F.col("l_orderkey").alias("job_id"))
    f = JobFilters(province=("ASIA", "EUROPE", "MIDDLE EAST"))
    out = market.overview(t.view(JOBS), records, f)
    return out.withColumns({c: F.to_date(c) for c in ("observed_from", "observed_to")})


@query("publisher_sites", f"select {HOST} as site, count(*) as jobs from jobs where source_url is not null group by 1", jobs=JOBS)
def _(t):
    return t.view(JOBS).filter("source_url is not null").groupBy(publisher_site("source_url").alias("site")).agg(
        F.count("*").alias("jobs"))


@query("dataset_scope", f"""
    select cast(min(last_seen_at) as date) as observed_from, cast(max(last_seen_at) as date) as observed_to,
           cast(min(published_at) as date) as published_from, cast(max(published_at) as date) as published_to,
           count(distinct {HOST}) as publisher_sites,
           coalesce(max(last_seen_at) < timestamp '{AS_OF}' - interval '30' day, true) as is_historical,
           (select count(*) from sources where id in (select primary_source_id from jobs)) as sources,
           (select count(coverage_note) from sources where id in (select primary_source_id from jobs)) as coverage_notes
    from jobs""", jobs=JOBS, sources=SOURCES)
def _(t):
    out = market.dataset_scope(t.view(JOBS), t.view(SOURCES), None, AS_OF)
    days = {c: F.to_date(c) for c in ("observed_from", "observed_to", "published_from", "published_to")}
    return out.withColumns(days)


@query("scope_sources", "select id, name, coverage_note from sources where id in (select primary_source_id from jobs)", jobs=JOBS, sources=SOURCES)
def _(t):
    return market.scope_sources(t.view(JOBS), t.view(SOURCES), None, AS_OF)


@query("source_coverage", """
    select s.id, s.permission_status, coalesce(j.n, 0) as job_count, cast(r.t as date) as last_success
    from sources s left join (select primary_source_id as id, count(*) as n from jobs group by 1) j using (id)
         left join (select source_id as id, max(finished_at) as t from runs where status = 'SUCCEEDED' group by 1) r using (id)""",
       jobs=JOBS, sources=SOURCES, runs=RUNS)
def _(t):
    out = market.source_coverage(t.view(SOURCES), t.view(JOBS), t.view(RUNS))
    return out.select("id", "permission_status", "job_count", F.to_date("last_success_at").alias("last_success"))


@query("latest_run_per_source", """
    select source_id, arg_max(status, started_at) as last_run_status, cast(max(started_at) as date) as last_run_day,
           cast(max(finished_at) filter (where status = 'SUCCEEDED') as date) as last_success
    from runs group by 1""", runs=RUNS)
def _(t):
    registry = t.view(SOURCES).select("id")
    out = market.admin_sources(registry, t.view(RUNS)).filter("last_run_at is not null")
    return out.select(F.col("id").alias("source_id"), "last_run_status", F.to_date("last_run_at").alias("last_run_day"),
                      F.to_date("last_success_at").alias("last_success"))


@query("salary_overview", f"""
    select count(*) as total_jobs, count(*) filter (where {COMPARABLE}) as eligible,
           count(*) filter (where salary_status = 'DISCLOSED' and salary_currency = 'IDR' and not ({COMPARABLE}))
               as excluded_implausible,
           count(*) filter (where {COMPARABLE} and salary_period_assumed) as period_assumed,
           {", ".join(f"count(*) filter (where {COMPARABLE} and list_contains(quality_flags, '{f}')) as {f.lower()}" for f in salary_stats.FLAGS)},
           {", ".join(f"round(quantile_cont({MIDPOINT}, {p}) filter (where {COMPARABLE}), 2) as p{round(p * 100)}" for p in (.1, .25, .5, .75, .9))},
           round(quantile_cont(salary_monthly_min, 0.5) filter (where {COMPARABLE}), 2) as median_min,
           round(quantile_cont(salary_monthly_max, 0.5) filter (where {COMPARABLE}), 2) as median_max
    from jobs""", jobs=JOBS)
def _(t):
    out = salary_stats.salary_overview(t.view(JOBS))
    return rounded(out, "p10", "p25", "p50", "p75", "p90", "median_min", "median_max", digits=2)


@query("salary_status_counts", "select salary_status, count(*) as count from jobs group by 1", jobs=JOBS)
def _(t):
    return salary_stats.status_counts(t.view(JOBS))


@query("salary_histogram_dense", f"""
    with b as (select cast(least(floor({MIDPOINT} / 2000000), 15) as bigint) as bin, count(*) as n
               from jobs where {COMPARABLE} group by 1)
    select i * 2000000 as lower, case when i < 15 then (i + 1) * 2000000 end as upper, coalesce(n, 0) as count
    from range(16) g(i) left join b on b.bin = g.i""", jobs=JOBS)
def _(t):
    return salary_stats.dense_histogram(t.view(JOBS))


def _top_sql(column, limit=20):
    """The comparison cut at a limit, with the number of groups and what the others hold."""
    return f"""with g as ({_compare_sql(column, limit="")}), top as (select * from g order by n desc, key asc nulls last limit {limit})
        select *, (select count(*) from g) as distinct_values, cast((select sum(n) from g) - (select sum(n) from top) as bigint) as other_count from top"""


def _compare_sql(column, source="jobs", ok=COMPARABLE, limit="limit 20"):
    qs = ", ".join(
        f"case when count(*) filter (where {ok}) >= 5 then round(quantile_cont({MIDPOINT}, {p}) filter (where {ok}), 2) end as {n}"
        for p, n in ((.25, "p25"), (.5, "median"), (.75, "p75")))
    return f"""select {column} as key, count(*) filter (where {ok}) as n, count(*) as jobs_in_group, {qs},
        count(*) filter (where {ok}) < 20 as small_sample from {source} group by 1 order by 2 desc, 1 asc nulls last {limit}"""


@query("salary_compare_by_city", _top_sql("city"), jobs=JOBS)
def _(t):
    return rounded(salary_stats.salary_compare(t.view(JOBS), "city"), "p25", "median", "p75", digits=2).drop("label")


@query("salary_compare_by_role_family", _top_sql("role_family"), jobs=JOBS)
def _(t):
    return rounded(salary_stats.salary_compare(t.view(JOBS), "role_family"), "p25", "median", "p75", digits=2).drop("label")


@query("tag_summary", """
    with s as (select distinct primary_source_id from jobs where len(source_tags) > 0 or hidden_tag_count > 0)
    select count(*) as total_jobs, count(*) filter (where len(source_tags) > 0) as jobs_with_visible_tags,
           count(*) filter (where hidden_tag_count > 0) as jobs_with_hidden_tags,
           cast(sum(len(source_tags)) as bigint) as visible_tags, cast(sum(hidden_tag_count) as bigint) as hidden_tags
    from jobs where primary_source_id in (select * from s)""", jobs=JOBS)
def _(t):
    return tags.tag_summary(t.view(JOBS))


@query("top_tags", """
    with g as (select tag, count(*) as count from (select unnest(source_tags) as tag from jobs where role_family = 'FURNITURE') group by 1),
         top as (select * from g order by count desc, tag limit 20)
    select *, (select count(*) from g) as distinct_values, cast((select sum(count) from g) - (select sum(count) from top) as bigint) as other_count from top""", jobs=JOBS)
def _(t):
    return tags.top_tags(t.view(JOBS), JobFilters(role_family=("FURNITURE",), **FREE))


@query("tag_role_families", "select role_family, count(*) as count from jobs where salary_status = 'DISCLOSED' group by 1", jobs=JOBS)
def _(t):
    return tags.tag_role_families(t.view(JOBS), JobFilters(role_family=("FURNITURE",), salary_disclosed=True, **FREE))


_ORDER = {
    "newest": f"case when expires_at < timestamp '{AS_OF}' then 1 else 0 end, "
              "coalesce(published_at, last_seen_at - interval '1' day * posted_age_days) desc, id",
    "salary_desc": f"case when {COMPARABLE} then salary_monthly_max end desc nulls last, id",
    "title": "lower(title), id",
    "company": "lower(company_name) asc nulls last, id",
}
for _sort, _keys in _ORDER.items():
    @query(f"search_sorted_by_{_sort}", f"""
        select id, title, (select count(*) from jobs where province = 'ASIA') as total from jobs
        where province = 'ASIA' order by {_keys} limit 50 offset 50""", jobs=JOBS)
    def _(t, sort=_sort):
        out = search.search_jobs(t.view(JOBS), JobFilters(province=("ASIA",)), sort, 2, 50, AS_OF)
        return out.select("id", "title", "total")


@query("search_by_relevance")
def _(t):
    """Trigram relevance of a query to titles; no SQL twin, tested against brute force."""
    f = JobFilters(q="furniture high", **FREE)
    return search.search_jobs(t.view(JOBS), f, "relevance", 1, 50, AS_OF).select("id", "title", "total")


@query("job_summaries", f"""
    select id, title, province, salary_status as status_code,
           case salary_status when 'DISCLOSED' then 'Dicantumkan' else 'Tidak dicantumkan' end as status_label,
           ({COMPARABLE}) as comparable, {LIFECYCLE} as freshness, concat('Source ', primary_source_id) as source_name,
           source_url from jobs""", jobs=JOBS)
def _(t):
    text = F.lit(None).cast("string")
    extra = {c: text for c in ("location_text", "location_confidence", "experience_text", "salary_text", "salary_period", "posted_text")}
    numbers = {c: F.lit(None).cast("int") for c in ("experience_min_years", "experience_max_years", "salary_min", "salary_max")}
    jobs = t.view(JOBS).withColumns(extra | numbers | {"is_urgent": F.lit(False)})
    sources = t.view(SOURCES).withColumns({"attribution_text": text, "technical_method": text})
    out = market.job_summaries(jobs, sources, AS_OF)
    return out.select("id", "title", F.col("location.province").alias("province"), F.col("salary.status.code").alias("status_code"),
                      F.col("salary.status.label").alias("status_label"), F.col("salary.comparable").alias("comparable"),
                      F.col("freshness.code").alias("freshness"), F.col("source.name").alias("source_name"), "source_url")


@query("safe_links", """
    select page_id, case when lower(link) like 'http://%' or lower(link) like 'https://%' then link end as link
    from (select page_id, unnest([url, replace(url, 'http', 'ftp'), replace(url, 'http', 'HTTP')]) as link from pages)""")
def _(t):
    u = F.col("url")
    links = t.pages.select("page_id", F.explode(F.array(u, F.replace(u, F.lit("http"), F.lit("ftp")), F.replace(u, F.lit("http"), F.lit("HTTP")))).alias("link"))
    return links.select("page_id", safe_link("link").alias("link"))


@query("job_detail", """
    select o_orderkey as id, count(*) as records, min(l_suppkey) as first_source, max(l_suppkey) as last_source
    from orders join lineitem on o_orderkey = l_orderkey where o_orderkey = (select max(l_orderkey) from lineitem) group by 1""")
def _(t):
    wanted = t.lineitem.agg(F.max("l_orderkey")).scalar()
    jobs = t.orders.select(F.col("o_orderkey").alias("id"))
    records = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("source_id"),
                                F.col("l_linenumber").alias("source_key"), F.col("l_shipdate").alias("first_seen_at"),
                                F.col("l_shipdate").alias("last_seen_at"))
    sources = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = market.job_detail(jobs, records, sources, wanted)
    ids = F.transform("source_records", lambda r: r["source_id"])
    return out.select("id", F.size("source_records").cast("bigint").alias("records"),
                      F.array_min(ids).alias("first_source"), F.array_max(ids).alias("last_source"))


@query("missing_values", """
    select unnest(['company_name', 'city', 'province', 'employment_type', 'experience', 'education', 'salary', 'source_url', 'published_at']) as field,
           unnest([count(*) filter (where company_name is null), count(*) filter (where city is null),
                   count(*) filter (where province is null), count(*) filter (where employment_type = 'UNKNOWN'),
                   count(*) filter (where experience_band = 'UNKNOWN'), count(*) filter (where education_level = 'UNKNOWN'),
                   count(*) filter (where salary_status <> 'DISCLOSED'), count(*) filter (where source_url is null),
                   count(*) filter (where published_at is null)]) as missing
    from jobs""", jobs=JOBS)
def _(t):
    return quality.missing_values(t.view(JOBS))


@query("flag_frequencies", "select flag, count(*) as count from (select unnest(quality_flags) as flag from jobs) group by 1", jobs=JOBS)
def _(t):
    return quality.list_frequencies(t.view(JOBS), "quality_flags", "flag")


@query("code_counts", """
    select 'salary_status' as "column", salary_status as key, count(*) as count from jobs group by 2
    union all select 'work_arrangement', work_arrangement, count(*) from jobs group by 2
    union all select 'experience_band', experience_band, count(*) from jobs group by 2""", jobs=JOBS)
def _(t):
    return quality.code_counts(t.view(JOBS), ("salary_status", "work_arrangement", "experience_band"))


@query("same_source_fingerprints", """
    with g as (select primary_source_id, fingerprint, count(*) as n from jobs group by 1, 2 having count(*) > 1)
    select count(*) as same_source_fingerprint_groups, cast(coalesce(sum(n), 0) as bigint) as jobs_in_fingerprint_groups from g""", jobs=JOBS)
def _(t):
    return quality.same_source_fingerprints(t.view(JOBS))


@query("job_constraints", """
    select 'salary_bounds_ordered' as rule, cast(id as varchar) as key from jobs where salary_monthly_min > salary_monthly_max
    union all select 'salary_amounts_only_when_disclosed', cast(id as varchar) from jobs where salary_status <> 'DISCLOSED'
    union all select 'work_arrangement_in_vocabulary', cast(id as varchar) from jobs where work_arrangement not in ('REMOTE', 'UNKNOWN')""", jobs=JOBS)
def _(t):
    jobs = t.view(JOBS).withColumnsRenamed({"salary_monthly_min": "salary_min", "salary_monthly_max": "salary_max"})
    return quality.violations(jobs, quality.job_constraints({"work_arrangement": {"REMOTE": "", "UNKNOWN": ""}}), "id")


@query("duplicate_fingerprints", "select fingerprint, count(*) as rows from jobs group by 1 having count(*) > 1", jobs=JOBS)
def _(t):
    return quality.duplicate_keys(t.view(JOBS), ["fingerprint"])


@query("completeness_shares", """
    select unnest(['city', 'published', 'disclosed', 'company']) as field,
           unnest([round(avg((city is not null)::int), 4), round(avg((published_at is not null)::int), 4),
                   round(avg((salary_status = 'DISCLOSED')::int), 4), round(avg((company_name is not null)::int), 4)]) as share
    from jobs""", jobs=JOBS)
def _(t):
    return quality.shares(t.view(JOBS), {
        "city": F.col("city").isNotNull(), "published": F.col("published_at").isNotNull(),
        "disclosed": F.col("salary_status") == "DISCLOSED", "company": F.col("company_name").isNotNull()})


@query("source_eligibility", f"""
    select id, case when permission_status not in ('APPROVED', 'APPROVED_WITH_CONDITIONS') then 'not approved'
                    when is_paused then 'paused by an operator' when connector is null then 'no connector configured'
                    when reviewed_at is null then 'no recorded policy review'
                    when reviewed_at < timestamp '2001-06-01 00:00:00' - interval '365' day then 'policy review has expired' end as refusal
    from sources""", sources=SOURCES)
def _(t):
    return t.view(SOURCES).select("id", policy.refusal_reason("collect", "2001-06-01 00:00:00").alias("refusal"))


@query("seeded_title_sample", None, jobs=JOBS)
def _(t):
    """Repeatable sample for labelling (the hash order is Spark's, so there is no SQL twin)."""
    return search.seeded_sample(t.view(JOBS).select("id", "title"), "id", 200, 7)


@query("top_city_share", """
    select round((select sum(n) from (select count(*) as n from jobs where city is not null group by city order by n desc limit 5))
        / (select count(*) from jobs where city is not null), 4) as share""", jobs=JOBS)
def _(t):
    return search.top_share(t.view(JOBS), "city", 5)


@query("salary_by_province_reliable", _compare_sql("province", ok="work_arrangement = 'REMOTE' and (salary_monthly_min + salary_monthly_max) / 2.0 >= 500000", limit=""), jobs=JOBS)
def _(t):
    jobs = t.view(JOBS).withColumn("salary_reliable", F.col("work_arrangement") == "REMOTE")
    out = gold.salary_by(jobs, "province").withColumnRenamed("vacancies", "jobs_in_group")
    return rounded(out, "p25", "median", "p75", digits=2)


@query("capped_histogram", f"""
    select least(floor({MIDPOINT} / 1000000), 12) * 1000000 as lower_bound, count(*) as vacancies
    from jobs where {COMPARABLE} group by 1""", jobs=JOBS)
def _(t):
    out = gold.capped_histogram(t.view(JOBS).filter(comparable_salary()), monthly_midpoint(), 1_000_000, 12)
    return out.withColumn("lower_bound", F.col("lower_bound").cast("double"))


# --- merges: two snapshots of the same orders ------------------------------------------------

OLD = """
select o_orderkey as source_key, 'src' as source_id, concat(o_orderstatus, o_orderpriority) as content_hash,
       'v1' as normalization_version, o_orderstatus as status_now, cast(o_orderdate as timestamp) as first_seen_at,
       cast(o_orderdate as timestamp) + interval '30' day as last_seen_at
from {orders} where o_orderdate < timestamp '1999-01-01 00:00:00'
"""
NEW = """
select o_orderkey as source_key, 'src' as source_id,
       concat(case when o_totalprice > 400000 then 'X' else o_orderstatus end, o_orderpriority) as content_hash,
       'v1' as normalization_version, case when o_totalprice > 400000 then 'X' else o_orderstatus end as status_now,
       cast(o_orderdate as timestamp) - interval '5' day as first_seen_at,
       cast(o_orderdate as timestamp) + interval '10' day as last_seen_at
from {orders} where o_orderdate >= timestamp '1997-01-01 00:00:00'
"""


def _upserted(t):
    return merge.upsert(t.view(OLD), t.view(NEW), ["source_id", "source_key"], ["status_now"], version="v1")


_MERGED = """
    select coalesce(o.source_key, n.source_key) as source_key,
           case when n.source_key is null then 'kept' when o.source_key is null then 'created'
                when o.content_hash <> n.content_hash then 'updated' else 'unchanged' end as outcome,
           case when o.source_key is null or o.content_hash <> n.content_hash then n.status_now else o.status_now end as status_now,
           cast(least(o.first_seen_at, n.first_seen_at) as date) as first_seen,
           cast(greatest(o.last_seen_at, n.last_seen_at) as date) as last_seen
    from old_rows o full outer join new_rows n on o.source_key = n.source_key"""


@query("snapshot_upsert", _MERGED, old_rows=OLD, new_rows=NEW)
def _(t):
    return _upserted(t).select("source_key", "outcome", "status_now", F.to_date("first_seen_at").alias("first_seen"),
                               F.to_date("last_seen_at").alias("last_seen"))


@query("run_record", f"""
    with m as ({_MERGED})
    select count(*) filter (where outcome = 'created') as records_created,
           count(*) filter (where outcome = 'updated') as records_updated,
           count(*) filter (where outcome = 'unchanged') as records_unchanged,
           (select count(*) from orders where o_orderstatus = 'P') as records_rejected, 'PARTIAL' as status
    from m""", old_rows=OLD, new_rows=NEW)
def _(t):
    rejects = t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("source_key"), F.lit("no title").alias("reject_reason"))
    out = merge.run_record(_upserted(t).withColumn("matched", F.lit(False)), rejects)
    return out.select("records_created", "records_updated", "records_unchanged", "records_rejected", "status")


@query("unlisted_records", "select source_key from old_rows where source_key not in (select source_key from new_rows)", old_rows=OLD, new_rows=NEW)
def _(t):
    return merge.unlisted_records(t.view(OLD), t.view(NEW), "src").select("source_key")


@query("orphaned_jobs", """
    select count(*) as jobs_left from (select distinct o_custkey from orders
    where not (o_custkey in (select o_custkey from orders where o_orderdate < timestamp '1997-01-01 00:00:00')
               and o_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1997-01-01 00:00:00')))""")
def _(t):
    o = t.orders
    records = o.select(F.lit("src").alias("source_id"), F.col("o_orderkey").alias("source_key"), F.col("o_custkey").alias("job_id"), "o_orderdate")
    jobs = o.select(F.col("o_custkey").alias("id")).distinct()
    listed = records.filter("o_orderdate >= timestamp '1997-01-01 00:00:00'").select("source_key")
    left, _ = merge.retire(jobs, records.drop("o_orderdate"), listed, "src")
    return left.agg(F.count("*").alias("jobs_left"))


@query("cross_source_match", """
    with j as (select fingerprint, count(*) as n, min(id) as job_id from jobs where primary_source_id <> 'NATION_1' group by 1)
    select i.id as source_key, j.job_id from jobs i join j using (fingerprint) where i.primary_source_id = 'NATION_1' and j.n = 1""", jobs=JOBS.replace("concat(c.c_name, '|', o.o_orderpriority)", "concat(substr(cast(o.o_orderdate as @string), 1, 10), o.o_orderpriority)"))
def _(t):
    jobs = t.view(JOBS.replace("concat(c.c_name, '|', o.o_orderpriority)", "concat(substr(cast(o.o_orderdate as @string), 1, 10), o.o_orderpriority)"))
    incoming = jobs.filter("primary_source_id = 'NATION_1'").select(F.col("id").alias("source_key"), "fingerprint")
    return merge.cross_source_matches(jobs, incoming, "NATION_1")


REVIEWED = SOURCES.replace("timestamp '2000-01-01 00:00:00' + interval '30' day * n.n_nationkey",
                           "timestamp '2000-07-01 00:00:00'").replace("'BLOCKED'", "'NEEDS_REVIEW'")


@query("registry_sync", """
    select o.id, case when o.reviewed_at is null or n.reviewed_at > o.reviewed_at then n.permission_status else o.permission_status end
           as permission_status,
           case when (o.reviewed_at is null or n.reviewed_at > o.reviewed_at) and o.permission_status <> n.permission_status
                then 'source.permission_changed' end as audit
    from sources o join reviewed n using (id)""", sources=SOURCES, reviewed=REVIEWED)
def _(t):
    table, audit = merge.sync_registry(t.view(SOURCES), t.view(REVIEWED).filter("reviewed_at is not null or id is not null"))
    return table.join(audit.select(F.col("entity_id").alias("id"), F.col("action").alias("audit")), "id", "left").select("id", "permission_status", "audit")


@query("registry_decisions", """
    select id, case when connector is null then 'record an approval before resuming' end as refusal_text,
           is_paused and permission_status = 'BLOCKED' as paused_now
    from (select id, is_paused, permission_status, case when permission_status = 'BLOCKED' then null else 'ok' end as connector from sources)""", sources=SOURCES)
def _(t):
    registry = t.view(SOURCES)
    decisions = registry.select("id", F.lit("ops").alias("actor"), F.lit("resume").alias("action"),
                                F.lit(None).cast("string").alias("status"), F.lit("back").alias("reason"),
                                F.lit(None).cast("string").alias("evidence_url"))
    table, audit = merge.apply_decisions(registry, decisions, AS_OF)
    return audit.select(F.col("entity_id").alias("id"), F.col("refusal").alias("refusal_text")).join(
        table.select("id", F.col("is_paused").alias("paused_now")), "id")


# --- published runs: customers as postings of two sources, five runs -------------------------

# Two boards list customers; what they list is decided by the balance, so some are listed by both.
LISTED = """
select c_custkey as k, c_name as company_name, c_mktsegment as segment, c_acctbal as b, concat('Staff ', c_mktsegment) as title from {customer}
"""
RUN_TIME = "timestamp '2000-06-01 00:00:00'"


def _published(t) -> versions.VersionedTables:
    """First import of two sources, a complete snapshot of the first, a refused run, a snapshot with rejects."""
    store = versions.VersionedTables(t.spark, f"{checkpoint_dir(t.spark).rstrip('/')}/published-{uuid.uuid4().hex}")
    registry = t.view(SOURCES).select("id", "permission_status", "is_paused", "connector", "reviewed_at")
    approved = F.lit("APPROVED"), F.lit(False), F.lit("feed"), F.expr(RUN_TIME)
    registry = registry.unionByName(registry.limit(1).select(
        F.explode(F.array(F.lit("board"), F.lit("career"))).alias("id"), *[c.alias(n) for c, n in zip(approved, registry.columns[1:])]))
    listed = t.view(LISTED)

    def rows(where: str, title: str = "title"):
        return listed.filter(where).select(
            F.col("k").cast("string").alias("source_key"), F.expr(title).alias("title"), "company_name",
            F.create_map(F.lit("key"), F.col("k").cast("string"), F.lit("title"), F.expr(title)).alias("raw_fields"))

    senior = "case when segment = 'BUILDING' then concat('Senior ', title) else title end"
    day = datetime(2000, 6, 1, tzinfo=timezone.utc)
    for n, (source, where, title, whole) in enumerate((
        ("board", "b < 5000", "title", False), ("career", "b >= 4000", "upper(title)", False), ("board", "b < 3000", senior, True),
        ("NATION_3", "b < 0", "title", False), ("career", "b >= 4000", "case when segment <> 'MACHINERY' then title end", True),
    )):
        publish.run_source(store, registry, rows(where, title), source, day + timedelta(days=n), replaces_snapshot=whole)
    return store


@query("published_runs", """
    with counted as (
        select count(*) filter (where b < 5000) as board, count(*) filter (where b >= 4000) as career,
               count(*) filter (where b >= 4000 and b < 5000) as both_list, count(*) filter (where b < 3000) as left_over,
               count(*) filter (where b < 3000 and segment = 'BUILDING') as changed,
               count(*) filter (where b >= 4000 and segment = 'MACHINERY') as untitled, count(*) as all_listed,
               count(*) filter (where b >= 3000 and b < 4000) as orphans from listed
    )
    select cast(1 as bigint) as number, 'board' as source_id, 'SUCCEEDED' as status, null as message, true as published, board as records_seen, board as records_created,
           0 as records_updated, 0 as records_unchanged, 0 as records_rejected, 0 as cross_source_matches, null as retired_records,
           null as retired_jobs, board as jobs_after, board as records_after from counted
    union all select 2, 'career', 'SUCCEEDED', null, true, career, career, 0, 0, 0, both_list, null, null, all_listed, board + career from counted
    union all select 3, 'board', 'SUCCEEDED', null, true, left_over, 0, changed, left_over - changed, 0, 0, board - left_over, orphans,
                     all_listed - orphans, left_over + career from counted
    union all select 4, 'NATION_3', 'REFUSED', 'not approved', false, 0, 0, 0, 0, 0, 0, null, null, all_listed - orphans, left_over + career from counted
    union all select 5, 'career', 'FAILED', 'incomplete snapshot (some records were rejected); nothing was published', false, career, 0, 0, 0, untitled,
                     0, null, null, all_listed - orphans, left_over + career from counted""", listed=LISTED)
def _(t):
    """The log of five runs, each with the number of jobs and records that readers of its version see."""
    store = _published(t)
    sizes = [
        store.read("jobs", n).agg(F.lit(n).cast("bigint").alias("number"), F.count("*").alias("jobs_after"))
        .withColumn("records_after", store.read("records", n).agg(F.count("*").alias("n")).scalar()) for n in store.numbers()
    ]
    counts = ("records_seen", "records_created", "records_updated", "records_unchanged", "records_rejected", "cross_source_matches", "retired_records", "retired_jobs")
    return store.runs().select("number", "source_id", "status", "message", "published", *counts).join(reduce(lambda a, b: a.unionByName(b), sizes), "number")


@query("published_jobs", """
    select company_name, b < 5000 as after_first, true as after_second, b < 3000 or b >= 4000 as after_third,
           case when b < 3000 and segment = 'BUILDING' then concat('Senior ', title) when b < 5000 then title else upper(title) end as last_title,
           case when b < 5000 then 'board' else 'career' end as primary_source_id,
           case when b < 3000 then cast('2000-06-03' as date) when b >= 4000 then cast('2000-06-02' as date) else cast('2000-06-01' as date) end as last_seen
    from listed""", listed=LISTED)
def _(t):
    """Jobs as readers of the first three versions see them; the row is that of the last version that has the job."""
    store = _published(t)
    seen = reduce(lambda a, b: a.unionByName(b), [store.read("jobs", n).withColumn("number", F.lit(n)) for n in (1, 2, 3)])
    newest = F.max_by(F.struct("title", "primary_source_id", "last_seen_at"), "number")
    jobs = seen.groupBy("company_name").agg(newest.alias("j"), *[
        F.bool_or(F.col("number") == n).alias(f"after_{name}") for n, name in enumerate(("first", "second", "third"), 1)])
    return jobs.select("company_name", "after_first", "after_second", "after_third", F.col("j.title").alias("last_title"),
                       F.col("j.primary_source_id").alias("primary_source_id"), F.to_date("j.last_seen_at").alias("last_seen"))
