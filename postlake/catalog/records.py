"""Queries over sightings, records and openings: collapse, detectors, windows, fuzzy merge."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postlake.catalog.base import query
from postlake.functions.similarity import jaro_winkler
from postlake.functions.text import normalize_for_matching
from postlake.operators import components, fuzzy, openings, policy, records, templates, vacancies
from postlake.plans import gold
from postlake.session import checkpoint_dir
from postlake.sources import index_files, lake
from postlake.streaming import sightings
from postlake.streaming.jobs import opening_sessions

# Events as sightings: an error event carries no values, so column-wise and row-wise differ.
SIGHTINGS = """
select user_id as source_record_key, event_type as crawl, ts as captured_at, event_id as content_digest,
       case when event_id > 50 then concat('batch-', length(props)) end as bronze_file,
       case when event_type <> 'error' then event_type end as kind,
       case when event_type <> 'error' then value end as amount, props
from {events}
"""
_LAST = "(captured_at, content_digest, bronze_file)"


@query("source_record_collapse", f"""
    select source_record_key, arg_max(kind, {_LAST}) as kind, arg_max(amount, {_LAST}) as amount,
           arg_max(props, {_LAST}) as props, cast(min(captured_at) as varchar)[:10] as first_seen,
           cast(max(captured_at) as varchar)[:10] as last_seen, count(*) as observations,
           count(distinct crawl) as crawls_observed, string_agg(distinct crawl, ',' order by crawl) as crawls
    from sightings group by 1""", sightings=SIGHTINGS)
def _(t):
    out = records.source_records(t.view(SIGHTINGS), provenance=("crawl", "captured_at", "bronze_file", "content_digest"))
    return out.select("source_record_key", "kind", "amount", "props",
                      F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"),
                      F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"),
                      "observations", "crawls_observed", F.array_join("crawls", ",").alias("crawls"))


@query("source_record_collapse_by_row", f"""
    select source_record_key, arg_max_null(kind, {_LAST}) as kind, arg_max_null(amount, {_LAST}) as amount
    from sightings group by 1""", sightings=SIGHTINGS)
def _(t):
    out = records.source_records(t.view(SIGHTINGS), provenance=("crawl", "captured_at", "bronze_file", "content_digest"), mode="row")
    return out.select("source_record_key", "kind", "amount")


@query("first_capture_per_key", """
    select user_id, event_type, event_id, value from events
    qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1""")
def _(t):
    out = records.first_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "value")


CAPTURES = """
select cast(l_orderkey as @string) as page_url, cast(l_partkey as @string) as content_digest, l_linenumber as posting_position,
       'capture' as observation_type, l_returnflag as crawl, l_shipdate as captured_at,
       concat('f', l_suppkey) as bronze_file, l_extendedprice as amount
from {lineitem}
"""
AGAIN = """
select l_linestatus as crawl, cast(l_orderkey as @string) as url, cast(l_partkey as @string) as content_digest,
       timestamp '2005-01-01 00:00:00' as index_fetch_time
from {lineitem}
"""


@query("captures_with_reobservations", """
    with f as (select * from captures qualify row_number() over
                   (partition by page_url, content_digest, posting_position order by captured_at, bronze_file, crawl, amount) = 1),
         a as (select distinct crawl, url, content_digest, index_fetch_time from again),
         u as (select observation_type, crawl, page_url, amount from captures union all
               select 'reobservation', a.crawl, f.page_url, f.amount from f join a on f.page_url = a.url and f.content_digest = a.content_digest)
    select observation_type, crawl, count(*) as rows, count(distinct page_url) as pages, round(sum(amount), 0) as amount
    from u group by 1, 2""", captures=CAPTURES, again=AGAIN)
def _(t):
    out = records.with_reobservations(t.view(CAPTURES), t.view(AGAIN))
    return out.groupBy("observation_type", "crawl").agg(
        F.count("*").alias("rows"), F.count_distinct("page_url").alias("pages"), F.round(F.sum("amount"), 0).alias("amount"))


@query("salary_template_sites", """
    with p as (select l_suppkey, l_discount, l_tax, count(*) as n from lineitem group by all)
    select l_suppkey, cast(sum(n) as bigint) as disclosed, round(max(n) / sum(n), 6) as top_share
    from p group by 1 having sum(n) >= 10 and max(n) / sum(n) >= 0.03""")
def _(t):
    out = templates.dominant_value_sites(t.lineitem, "l_suppkey", ["l_discount", "l_tax"], share=0.03)
    return out.withColumn("top_share", F.round("top_share", 6))


DEADLINES = """
select c.c_custkey % 400 as site, cast(l.l_shipdate as date) as until, cast(o.o_orderdate as date) as posted
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {customer} c on o.o_custkey = c.c_custkey
"""


@query("deadline_template_sites", """
    with s as (select site, count(*) as deadlines from d group by 1),
         a as (select site, max(n) as n from (select site, until, count(*) as n from d group by all) group by 1),
         b as (select site, max(n) as n from (select site, until - posted as k, count(*) as n from d group by all) group by 1)
    select site, deadlines, round(greatest(a.n, b.n) / deadlines, 6) as top_share
    from s join a using (site) join b using (site) where deadlines >= 20 and greatest(a.n, b.n) / deadlines >= 0.02""", d=DEADLINES)
def _(t):
    out = templates.dominant_date_sites(t.view(DEADLINES), "site", "until", "posted", 20, 0.02)
    return out.withColumn("top_share", F.round("top_share", 6))


CAMPAIGNS = """
select c.c_mktsegment as site, o.o_orderpriority as employer, n.n_name as place, o.o_orderstatus as pay, o.o_orderkey as k
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
"""


@query("campaign_groups", """
    with s as (select site, employer, pay, count(*) as n from c group by all),
         g as (select site, employer, max(n) / sum(n) as top_share from s group by all),
         p as (select site, employer, count(distinct place) as places from c group by all)
    select site, employer, places, round(top_share, 6) as top_share from g join p using (site, employer)
    where places >= 5 and top_share >= 0.34""", c=CAMPAIGNS)
def _(t):
    out = templates.campaign_groups(t.view(CAMPAIGNS), ["site", "employer"], "place", "pay", share=0.34)
    return out.withColumn("top_share", F.round("top_share", 6))


@query("campaign_members_flagged", """
    with s as (select site, employer, pay, count(*) as n from c group by all),
         g as (select site, employer from s group by all having max(n) / sum(n) >= 0.34)
    select c.site, g.site is not null as templated, count(*) as rows
    from c left join g on c.site = g.site and c.employer = g.employer group by 1, 2""", c=CAMPAIGNS)
def _(t):
    rows = t.view(CAMPAIGNS)
    copied = templates.campaign_groups(rows, ["site", "employer"], "place", "pay", share=0.34)
    return templates.flag_members(rows, copied, ["site", "employer"], "templated").groupBy("site", "templated").agg(
        F.count("*").alias("rows"))


DATED = "select o_custkey, o_orderkey, cast(o_orderdate as date) as d from {orders}"


@query("date_gaps", """
    with days as (select o_custkey, d, count(*) as rows from dated group by all)
    select o_custkey, d, rows, d - lag(d) over (partition by o_custkey order by d) as gap from days""", dated=DATED)
def _(t):
    return openings.gaps(t.view(DATED), ["o_custkey"], "d").withColumn("gap", F.col("gap").cast("bigint"))


_RUNS = """
    with g as (select *, d - lag(d) over (partition by o_custkey order by d, o_orderkey) as gap from dated),
         r as (select o_custkey, d, sum(case when gap is null or gap > 45 then 1 else 0 end)
                          over (partition by o_custkey order by d, o_orderkey) as run from g)"""


@query("openings_by_gap", f"{_RUNS} select o_custkey, cast(run as bigint) as run, min(d) as first_day, count(*) as rows from r group by 1, 2", dated=DATED)
def _(t):
    runs = openings.date_runs(t.view(DATED), ["o_custkey"], "d")
    return runs.groupBy("o_custkey", "run").agg(F.min("d").alias("first_day"), F.sum("rows").alias("rows"))


@query("openings_by_session_window", f"{_RUNS} select o_custkey, min(d) as first_day, count(*) as rows from r group by o_custkey, run", dated=DATED)
def _(t):
    stamped = t.view(DATED).withColumn("at", F.col("d").cast("timestamp"))
    out = opening_sessions(stamped, ["o_custkey"], "at")
    return out.select("o_custkey", F.to_date("first_at").alias("first_day"), "rows")


@query("opening_count", f"{_RUNS} select count(*) as openings from (select distinct o_custkey, run from r)", dated=DATED)
def _(t):
    runs = openings.date_runs(t.view(DATED), ["o_custkey"], "d")
    return runs.select("o_custkey", "run").distinct().agg(F.count("*").alias("openings"))


TITLES = "select distinct p_brand, p_name from {part}"


@query("similar_titles", """
    select a.p_brand, a.p_name as "left", b.p_name as "right", round(jaro_winkler_similarity(a.p_name, b.p_name), 6) as score
    from titles a join titles b on a.p_brand = b.p_brand and a.p_name < b.p_name
    where jaro_winkler_similarity(a.p_name, b.p_name) >= 0.93""", titles=TITLES)
def _(t):
    out = fuzzy.similar_pairs(t.part, ["p_brand"], "p_name")
    return out.withColumn("score", F.round("score", 6))


_TITLE = "trim(regexp_replace(strip_accents(lower(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^0-9a-z+#]+', ' ', 'g'))"


@query("similar_page_titles", f"""
    with titles as (select distinct regexp_extract(html, 'lang="([a-z]+)"', 1) as lang, {_TITLE} as title from pages)
    select a.lang, a.title as "left", b.title as "right", round(jaro_winkler_similarity(a.title, b.title), 6) as score
    from titles a join titles b on a.lang = b.lang and a.title < b.title
    where jaro_winkler_similarity(a.title, b.title) >= 0.93""")
def _(t):
    titles = t.pages.select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        normalize_for_matching(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    out = fuzzy.similar_pairs(titles, ["lang"], "title")
    return out.withColumn("score", F.round("score", 6))


@query("jaro_winkler_scores", """
    select p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) as name_type,
           round(jaro_winkler_similarity(lower(p_brand), 'brand#21'), 6) as brand from part""")
def _(t):
    p = t.part
    return p.select("p_partkey", F.round(jaro_winkler("p_name", "p_type"), 6).alias("name_type"),
                    F.round(jaro_winkler(F.lower("p_brand"), F.lit("brand#21")), 6).alias("brand"))


@query("connected_components", """
    with recursive e as (
        select c_custkey as a, -1 - c_nationkey as b from customer),
      links as (select a, b from e union select b, a from e),
      reach as (select a as node, a as r from links union select links.b, reach.r from reach join links on reach.node = links.a)
    select node, min(r) as component from reach group by 1""")
def _(t):
    e = t.customer.select(F.col("c_custkey").alias("left"), (-1 - F.col("c_nationkey")).alias("right"))
    return components.connected_components(e)


# Parts as source records: employer = brand, title = name, place = type, date from size.
PARTS = """
select lpad(cast(p_partkey as @string), 8, '0') as source_record_key, concat('site', length(p_type)) as source_domain,
       p_brand as organization_key, p_name as title_key, p_name as title, lower(p_type) as city,
       cast(null as @string) as province, date '2024-01-01' + cast(p_size * 5 as int) as date_posted,
       timestamp '2024-06-01 00:00:00' as first_seen_at, timestamp '2024-06-02 00:00:00' as last_seen_at,
       case when p_retailprice > 901 then cast(p_partkey as bigint) end as salary_min,
       cast(null as bigint) as salary_max, true as is_valid, 1 as observations
from {part}
"""
_VACANCIES = """
    with recursive base as (
        select *, coalesce(lower(city), lower(province), '?') as place_key, date_posted as d,
               coalesce(salary_min::varchar, '-') || '/' || coalesce(salary_max::varchar, '-') as pay from parts),
      sc as (select source_domain, organization_key, title_key, pay, count(*) as n from base group by all),
      cg as (select source_domain, organization_key, title_key from sc group by all having max(n) / sum(n) >= 0.8),
      pl as (select source_domain, organization_key, title_key from base group by all having count(distinct place_key) >= 5),
      cand as (select base.* exclude (place_key), case when cg.title_key is not null and pl.title_key is not null then '*' else place_key end as place_key
               from base left join cg using (source_domain, organization_key, title_key) left join pl using (source_domain, organization_key, title_key)),
      gaps as (select *, d - lag(d) over w as gap from cand window w as (partition by organization_key, title_key, place_key order by d, source_record_key)),
      eg as (select *, organization_key || '|' || title_key || '|' || place_key || '|' ||
                 sum(case when gap is null or (gap > 45 and place_key <> '*') then 1 else 0 end) over
                     (partition by organization_key, title_key, place_key order by d, source_record_key) as g from gaps),
      gr as (select g, organization_key, place_key, title_key, min(d) as anchor from eg group by all),
      pr as (select a.g as x, b.g as y from gr a join gr b on a.organization_key = b.organization_key and a.place_key = b.place_key
             and a.g < b.g and a.title_key <> b.title_key
             where jaro_winkler_similarity(a.title_key, b.title_key) >= 0.93 and (a.place_key = '*' or abs(a.anchor - b.anchor) <= 45)),
      ed as (select x, y from pr union select y, x from pr),
      reach as (select g as node, g as r from gr union select ed.y, reach.r from reach join ed on reach.node = ed.x),
      comp as (select node, min(r) as v from reach group by 1),
      mem as (select eg.*, comp.v from eg join comp on comp.node = eg.g)"""
_MEMBER_COLUMNS = ("title", "salary_min", "source_domain")


def _parts(t):
    return t.view(PARTS).withColumn("crawls", F.array(F.lit("c1")))


@query("vacancy_members", f"""{_VACANCIES}
    select md5(min(source_record_key) over (partition by v)) as vacancy_id, source_record_key from mem""", parts=PARTS)
def _(t):
    return vacancies.member_table(vacancies.vacancy_members(_parts(t)))


@query("canonical_vacancies", f"""{_VACANCIES}
    select md5(min(source_record_key)) as vacancy_id, arg_min(title, (d, source_record_key)) as title,
           arg_min(salary_min, (d, source_record_key)) as salary_min, min(date_posted) as first_posted,
           count(*) as source_records, count(distinct source_domain) as source_sites, cast(sum(observations) as bigint) as observations,
           string_agg(distinct source_domain, ',' order by source_domain) as sites,
           count(distinct title_key) > 1 as merged_fuzzy, bool_or(place_key = '*') as city_templated
    from mem group by v""", parts=PARTS)
def _(t):
    rows = _parts(t)
    out = vacancies.collapse_vacancies(rows, vacancies.vacancy_members(rows))
    return out.select("vacancy_id", "title", "salary_min", F.col("date_posted").alias("first_posted"), "source_records",
                      "source_sites", "observations", F.array_join("sites", ",").alias("sites"), "merged_fuzzy", "city_templated")


YIELD = "select l_orderkey as vacancy_id, l_shipmonth as crawl from (select l_orderkey, substr(cast(l_shipdate as @string), 1, 7) as l_shipmonth from {lineitem}) group by 1, 2"


@query("crawl_yield", """
    with newest as (select vacancy_id, max(crawl) as c from m group by 1)
    select m.crawl, count(*) as vacancies, count(*) filter (where n.c = m.crawl) as not_in_newer_crawls
    from m join newest n using (vacancy_id) group by 1""", m=YIELD)
def _(t):
    lists = t.view(YIELD).groupBy("vacancy_id").agg(F.array_sort(F.collect_set("crawl")).alias("crawls"))
    return gold.crawl_yield(lists)


# Lineitems as captures of pages, orders as domains' candidates.
DOMAIN_CAPTURES = """
select concat('site', l_suppkey, '.id') as domain, 'ok' as fetch_result, case when l_returnflag = 'R' then 1 else 0 end as jobposting_count
from {lineitem}
"""


@query("domain_yield", """
    select domain, count(*) as tried, count(*) filter (where jobposting_count > 0) as hits from captures group by 1""", captures=DOMAIN_CAPTURES)
def _(t):
    return policy.domain_yield(t.view(DOMAIN_CAPTURES))


LOW_YIELD = """
select concat('u', o_orderkey) as url, concat('cust', o_custkey) as domain from {orders}
"""
ORDER_CAPTURES = """
select concat('cust', o_custkey) as domain, 'ok' as fetch_result, case when o_orderstatus = 'F' and o_totalprice > 250000 then 1 else 0 end as jobposting_count
from {orders}
"""


@query("fetch_order_without_low_yield", """
    with y as (select domain, count(*) as tried, count(*) filter (where jobposting_count > 0) as hits from captures group by 1)
    select p.url, p.domain, round(hits / tried, 6) as yield_rate from pending p join y using (domain) where not (tried >= 5 and hits = 0)""",
       pending=LOW_YIELD, captures=ORDER_CAPTURES)
def _(t):
    out = policy.fetch_order(t.view(LOW_YIELD), policy.domain_yield(t.view(ORDER_CAPTURES)), trials=5)
    return out.select("url", "domain", F.round("yield_rate", 6).alias("yield_rate"))


TRIAGE_CANDIDATES = """
select concat('p', o_custkey) as url, substr(o_orderpriority, 1, 1) as content_digest, o_orderstatus as warc_filename, o_orderkey as warc_record_offset
from {orders}
"""
TRIAGE_CAPTURES = """
select case when l_linenumber = 1 then 'new' else 'old' end as crawl, concat('p', l_partkey) as url,
       substr(cast(cast(l_quantity as int) as @string), 1, 1) as content_digest, case when l_returnflag = 'R' then 'network' else 'ok' end as fetch_result,
       case l_returnflag when 'A' then 'F' else 'O' end as warc_filename, l_orderkey as warc_record_offset
from {lineitem}
"""
TRIAGE_SEEN = """
select case when c_acctbal > 5000 then 'new' else 'old' end as crawl, concat('p', c_custkey) as url, '3' as content_digest from {customer}
"""


@query("candidate_triage", """
    with f as (select distinct warc_filename, warc_record_offset from captures where crawl = 'new' and fetch_result not in ('network')),
         k as (select distinct url, content_digest from seen where crawl = 'new'),
         s as (select distinct url, content_digest from captures where fetch_result = 'ok')
    select case when f.warc_filename is not null or k.url is not null then 'already_fetched' when s.url is not null then 'reobserved' else 'pending' end as triage,
           count(*) as candidates, cast(sum(c.warc_record_offset) as bigint) as offsets
    from candidates c left join f using (warc_filename, warc_record_offset) left join k on k.url = c.url and k.content_digest = c.content_digest
         left join s on s.url = c.url and s.content_digest = c.content_digest group by 1""",
       candidates=TRIAGE_CANDIDATES, captures=TRIAGE_CAPTURES, seen=TRIAGE_SEEN)
def _(t):
    out = policy.triage(t.view(TRIAGE_CANDIDATES), t.view(TRIAGE_CAPTURES), t.view(TRIAGE_SEEN), "new")
    return out.groupBy("triage").agg(F.count("*").alias("candidates"), F.sum("warc_record_offset").alias("offsets"))


SITE_ROWS = """
select case when r.r_name = 'ASIA' then 'lokerbogor.co.id' when r.r_name = 'EUROPE' then 'Indeed.com' when r.r_name = 'AFRICA' then 'groove.co.id'
            when c.c_acctbal < 0 then null else concat('site-', lower(c.c_mktsegment), '.id') end as source_domain,
       case when c.c_acctbal > 6000 then 'licensed-feed' else 'commoncrawl-jobposting' end as registry_source_id, c.c_custkey
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
"""


@query("usable_captures", """
    select source_domain, registry_source_id, count(*) as rows from s
    where lower(source_domain) <> 'indeed.com' and (registry_source_id <> 'commoncrawl-jobposting' or source_domain = 'lokerbogor.co.id')
    group by 1, 2""", s=SITE_ROWS)
def _(t):
    return policy.usable_captures(t.view(SITE_ROWS)).groupBy("source_domain", "registry_source_id").agg(F.count("*").alias("rows"))


@query("domain_governance", """
    select status, domain, n as observations from (
        select lower(source_domain) as domain, count(*) as n,
               case lower(source_domain) when 'indeed.com' then 'excluded_portal' when 'groove.co.id' then 'prohibits'
                    when 'lokerbogor.co.id' then 'no_statement' else 'unreviewed' end as status
        from s where registry_source_id = 'commoncrawl-jobposting' group by 1)""", s=SITE_ROWS)
def _(t):
    return policy.domain_governance(t.view(SITE_ROWS), policy.review_table(t.spark))


@query("governance_totals", """
    select status, cast(sum(n) as bigint) as observations, count(*) as domains from (
        select lower(source_domain) as domain, count(*) as n,
               case lower(source_domain) when 'indeed.com' then 'excluded_portal' when 'groove.co.id' then 'prohibits'
                    when 'lokerbogor.co.id' then 'no_statement' else 'unreviewed' end as status
        from s where registry_source_id = 'commoncrawl-jobposting' group by 1) group by 1""", s=SITE_ROWS)
def _(t):
    return policy.governance_totals(policy.domain_governance(t.view(SITE_ROWS), policy.review_table(t.spark)))


INDEX = """
select url, regexp_extract(url, '://([^/?#]+)', 1) as url_host_registered_domain, 200 as fetch_status, 'text/html' as content_mime_detected,
       cast(page_id as @string) as url_surtkey, page_id as warc_record_offset
from (select page_id, case when length(html) > 4000 then replace(url, '/en/', '/jobs/') else url end as url from {pages})
"""


@query("job_page_candidates", """
    select url, url_host_registered_domain as domain from i
    where regexp_matches(lower(url), '(lowongan|loker|karir|career|/jobs?/|/job-|vacanc|rekrutmen|recruit|hiring)')
      and url_surtkey >= '1' and url_surtkey < '8'""", i=INDEX)
def _(t):
    index = t.view(INDEX).withColumns({c: F.lit(None).cast("string") for c in ("content_digest", "warc_filename")} | {
        "fetch_time": F.lit(None).cast("timestamp"), "warc_record_length": F.lit(0)})
    return policy.job_candidates(policy.index_range(index, start="1", end="8")).select("url", "domain")


# Pages as rows of a sorted URL index: host names turned round, a file per top-level domain and length of the host.
INDEX_FILES = """
select page_id, url, {key} as url_surtkey, {folder} as folder
from (select page_id, url, regexp_extract(url, '://([^/?#]+)', 1) as h, regexp_extract(url, '://[^/?#]+(.*)$', 1) as p from pages)
"""
_HERE = {"key": "concat(array_join(reverse(split(h, '[.]')), ','), ')', p)", "folder": "concat(element_at(split(h, '[.]'), -1), '-', length(h))"}
_THERE = {"key": "concat(array_to_string(list_reverse(string_split(h, '.')), ','), ')', p)", "folder": "concat(string_split(h, '.')[-1], '-', length(h))"}


@query("index_files_read", f"""
    with i as ({INDEX_FILES.format(**_THERE)}), files as (
        select folder, count(*) as rows, min(url_surtkey) as least_key, max(url_surtkey) as greatest_key,
               count(*) filter (where url_surtkey >= 'org,' and url_surtkey < 'org-') as rows_in_range
        from i group by folder)
    select folder, rows, least_key, greatest_key, greatest_key >= 'org,' and least_key < 'org-' as read, rows_in_range from files""")
def _(t):
    """Files of an index by their footers, which of them a scan of one top-level domain reads, and what it finds there."""
    index = f"{checkpoint_dir(t.spark).rstrip('/')}/url-index-{uuid.uuid4().hex}"
    rows = t.spark.sql(INDEX_FILES.format(**_HERE).replace("from pages", "from {pages}"), pages=t.pages)
    lake.write_parquet(rows.repartition("folder"), index, partition_by=["folder"], sort_by=["folder", "url_surtkey"])
    index_files.refresh_manifest(t.spark, index)
    found = index_files.read_index_range(t.spark, index, "org,", "org-", schema="page_id bigint, url string, url_surtkey string")
    folder = F.regexp_extract("path", "folder=([^/]*)/", 1)
    scanned = t.spark.createDataFrame([(f,) for f in found.inputFiles()], "path string").select(folder.alias("folder"), F.lit(True).alias("read"))
    held = found.select(F.col("_metadata.file_path").alias("path")).groupBy(folder.alias("folder")).agg(F.count("*").alias("rows_in_range"))
    files = index_files.manifest(t.spark, index).read("files").withColumn("folder", folder)
    return files.join(scanned, "folder", "left").join(held, "folder", "left").select(
        "folder", "rows", "least_key", "greatest_key", F.coalesce("read", F.lit(False)).alias("read"),
        F.coalesce("rows_in_range", F.lit(0)).cast("bigint").alias("rows_in_range"))


@query("seen_times_stream", """
    select user_id, event_type, min(ts) as first_seen_at, max(ts) as last_seen_at, count(*) as sightings from events group by user_id, event_type""")
def _(t):
    """Events as a stream of files in no order of time, four batches of many files, with one state per key."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/seen-times-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    files = max(4, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(files, "event_id").write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/in")
    keys = ["user_id", "event_type"]
    sightings.keep_sightings(stream, keys, f"{folder}/seen", f"{folder}/checkpoint", "ts")
    return sightings.read_sightings(t.spark, keys, f"{folder}/seen")
