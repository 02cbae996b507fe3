"""Queries over gold-shaped tables, evaluation, reports and the snapshot profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.catalog.base import query
from postlake.operators import clustering, evaluation, quality, records
from postlake.operators.breakdown import top_per_group
from postlake.operators.percentiles import grouped_percentiles
from postlake.plans import gold, snapshot
from postlake.rules.words import UNKNOWN_PLACES


@query("grouped_percentiles", """
    select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 4) as p1, round(quantile_cont(l_extendedprice, 0.5), 4) as p50,
           round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by 1, 2""")
def _(t):
    out = grouped_percentiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.01, 0.5, 0.99))
    return out.withColumns({c: F.round(c, 4) for c in ("p1", "p50", "p99")})


@query("quartiles_per_supplier", """
    select l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(quantile_cont(l_extendedprice, 0.5), 4) as p50,
           round(quantile_cont(l_extendedprice, 0.75), 4) as p75 from lineitem group by 1""")
def _(t):
    out = grouped_percentiles(t.lineitem, ["l_suppkey"], "l_extendedprice", (0.25, 0.5, 0.75))
    return out.withColumns({c: F.round(c, 4) for c in ("p25", "p50", "p75")})


@query("counts_by_key", "select l_shipmode_, count(*) as vacancies from (select concat(l_returnflag, l_linestatus) as l_shipmode_ from lineitem) group by 1")
def _(t):
    return gold.count_by(t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_")), "l_shipmode_")


PLACES = """
select o.o_orderkey as vacancy_id, c.c_acctbal < 0 as city_templated, n.n_name as city, r.r_name as province,
       @list(case when o.o_totalprice > 50000 then r.r_name end, case when o.o_totalprice > 400000 then 'ASIA' end @end as provinces,
       cast(case when o.o_orderstatus <> 'P' then floor(o.o_totalprice / 40000) end as int) as experience_min_years,
       c.c_mktsegment as organization_key, lower(c.c_name) as organization, n.n_name as source_domain,
       case when n.n_nationkey < 12 then 'job_site' else 'other' end as site_type, c.c_acctbal > 9990 as salary_template_site
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
     join {region} r on n.n_regionkey = r.r_regionkey
"""


@query("vacancies_by_province", f"""
    select province, count(distinct vacancy_id) as vacancies from (
        select vacancy_id, unnest(case when city_templated or len(provinces) = 0 then ['{UNKNOWN_PLACES}'] else provinces end) as province from v)
    group by 1""", v=PLACES)
def _(t):
    return gold.by_province(t.view(PLACES))


@query("vacancies_by_city", "select province, city, count(*) as vacancies from v where city is not null and not city_templated group by all", v=PLACES)
def _(t):
    return gold.by_city(t.view(PLACES))


@query("vacancies_by_experience", """
    select case when experience_min_years is null then 'UNKNOWN' when experience_min_years < 1 then '<1' when experience_min_years < 3 then '1-2'
                when experience_min_years < 5 then '3-4' when experience_min_years < 10 then '5-9' else '10+' end as min_years, count(*) as vacancies
    from v group by 1""", v=PLACES)
def _(t):
    return gold.by_experience(t.view(PLACES))


@query("employers", "select organization_key, min(organization) as organization, count(*) as vacancies, count(distinct source_domain) as sites from v group by 1", v=PLACES)
def _(t):
    return gold.employers(t.view(PLACES))


@query("site_table", "select source_domain, site_type, count(*) as vacancies, count(*) filter (where salary_template_site) > 0 as salary_template_site from v group by 1, 2", v=PLACES)
def _(t):
    return gold.site_table(t.view(PLACES))


@query("postings_by_month", "select cast(date_trunc('month', d) as date) as month, count(*) as vacancies from (select cast(l_shipdate as date) as d from lineitem) group by 1")
def _(t):
    return gold.postings_by_month(t.lineitem.select(F.to_date("l_shipdate").alias("date_posted")))


LAG = """
select case when o.o_orderstatus <> 'P' then cast(o.o_orderdate as date) end as date_posted, l.l_shipdate as first_seen_at
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey
"""


@query("observation_lag", """
    select case when date_posted is null then 'unknown' when d <= 7 then '0-7 days' when d <= 30 then '8-30 days' when d <= 90 then '31-90 days'
                when d <= 365 then '91-365 days' else '>1 year' end as posted_before_first_capture, count(*) as vacancies
    from (select date_posted, cast(first_seen_at as date) - date_posted as d from lags) group by 1""", lags=LAG)
def _(t):
    return gold.observation_lag(t.view(LAG))


@query("list_shares_by_group", """
    with d as (select doc_id, lang, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: len(w) > 0))) as word from documents),
         n as (select lang, count(*) as denominator from documents group by 1)
    select lang, word, count(*) as vacancies, any_value(denominator) as denominator, round(count(*) / any_value(denominator), 6) as share
    from d join n using (lang) group by 1, 2 having count(*) >= 3""")
def _(t):
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), " "), ""))
    out = gold.list_shares(t.documents.select("lang", words.alias("words")), "words", "word", "lang", having=3)
    return out.withColumn("share", F.round("share", 6))


@query("top_values_per_group", """
    select l_returnflag, l_suppkey, n from (select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2)
    qualify row_number() over (partition by l_returnflag order by n desc, l_suppkey) <= 5""")
def _(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["l_returnflag"], [F.desc("n"), F.asc("l_suppkey")], 5)


LEVELS = """
select count(*) as observations, count(distinct l_orderkey) as source_records,
       count(distinct case when l_orderkey % 2 = 0 then l_orderkey end) as valid_source_records,
       count(distinct case when l_orderkey % 2 = 1 then l_orderkey end) as rejected_source_records,
       count(distinct l_suppkey) as canonical_vacancies from {lineitem}
"""


@query("reconciliation_checks", """
    select unnest(['observations >= source_records', 'source_records >= valid_source_records', 'valid_source_records >= vacancies', 'valid + rejected = source_records']) as name,
           unnest([source_records, valid_source_records, canonical_vacancies, source_records]) as expected,
           unnest([observations, source_records, valid_source_records, valid_source_records + rejected_source_records]) as actual,
           unnest([observations >= source_records, source_records >= valid_source_records, valid_source_records >= canonical_vacancies,
                   valid_source_records + rejected_source_records = source_records]) as ok from levels""", levels=LEVELS)
def _(t):
    return quality.ordered_levels(t.view(LEVELS))


@query("rebuild_identical", """
    select 'rebuild identical' as name, count(distinct l_orderkey) as expected, count(distinct l_orderkey) as actual, true as ok from lineitem""")
def _(t):
    """Source records of all lines, built twice over different partitionings."""
    def build(lines):
        sightings = lines.select(
            F.col("l_orderkey").alias("source_record_key"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("amount"),
            F.col("l_linestatus").alias("crawl"), F.col("l_shipdate").cast("timestamp").alias("captured_at"),
            F.col("l_linenumber").cast("string").alias("bronze_file"), F.col("l_partkey").cast("string").alias("content_digest"))
        return records.source_records(sightings, provenance=("crawl", "captured_at", "bronze_file", "content_digest"))

    return quality.same_rows(build(t.lineitem), build(t.lineitem.repartition("l_suppkey")))


INVENTORY = """
select o.o_orderkey as k, case when o.o_orderstatus = 'P' then 'reobservation' else 'capture' end as observation_type,
       o.o_totalprice > 30000 as is_valid, o.o_orderpriority as crawl, length(o.o_orderpriority) % 3 as source_sites,
       o.o_orderstatus = 'F' as merged_fuzzy, o.o_totalprice > 450000 as city_templated, cast(o.o_orderdate as date) as valid_through,
       o.o_orderstatus = 'O' as valid_through_reliable, o.o_custkey as organization_key, o.o_orderpriority as source_domain,
       @list(o.o_orderpriority, case when o.o_orderstatus = 'F' then 'x' end @end as crawls,
       cast(o.o_orderdate as timestamp) as first_seen_at, cast(o.o_orderdate as timestamp) + interval '10' day as last_seen_at,
       cast(o.o_orderdate as date) as date_posted
from {orders} o
"""


@query("inventory_counts", """
    select count(*) as observations, count(*) filter (where observation_type = 'reobservation') as observations_from_unchanged_recaptures,
           count(*) filter (where is_valid) as valid_observations, count(distinct crawl) as crawls_with_data, count(*) as source_records,
           count(*) filter (where is_valid) as valid_source_records, count(*) filter (where not is_valid) as rejected_source_records,
           count(*) filter (where is_valid) as canonical_vacancies, count(*) filter (where is_valid and source_sites > 1) as vacancies_on_multiple_sites,
           count(*) filter (where is_valid and merged_fuzzy) as vacancies_with_fuzzy_merge,
           count(*) filter (where is_valid and city_templated) as city_templated_campaigns,
           count(*) filter (where is_valid and not valid_through_reliable) as vacancies_with_template_deadline,
           count(*) filter (where is_valid and len(crawls) > 1) as vacancies_seen_in_multiple_crawls,
           count(distinct case when is_valid then organization_key end) as distinct_employers,
           count(distinct case when is_valid then source_domain end) as distinct_sites, 0.0::double as duplicate_rate_records_to_vacancies
    from i""", i=INVENTORY)
def _(t):
    rows = t.view(INVENTORY)
    return quality.inventory(rows, rows, rows.filter("is_valid")).withColumn(
        "duplicate_rate_records_to_vacancies", F.col("duplicate_rate_records_to_vacancies").cast("double"))


@query("time_coverage", """
    select cast(min(first_seen_at) as date) as first_capture, cast(max(last_seen_at) as date) as last_capture, min(date_posted) as earliest_date_posted,
           max(date_posted) as latest_date_posted,
           round(avg((valid_through < cast(last_seen_at as date))::int) filter (where valid_through_reliable), 4) as expired_at_last_capture_share
    from i""", i=INVENTORY)
def _(t):
    out = quality.time_coverage(t.view(INVENTORY))
    return out.withColumns({c: F.to_date(c) for c in ("first_capture", "last_capture")})


# --- evaluation -------------------------------------------------------------------------------

LABELS = """
select l.doc_id, case when d.n_chars > 400 then 'GOOD' else 'OTHER' end as predicted, case when l.quality = 1 then 'GOOD' else 'OTHER' end as label,
       case when l.toxic = 1 then 'OTHER' else 'GOOD' end as second
from {labels} l join {documents} d on l.doc_id = d.doc_id
"""


@query("classifier_scores", """
    select count(*) as titles, round(avg((predicted <> 'OTHER')::int), 6) as coverage,
           round(coalesce(avg((predicted = label)::int) filter (where predicted <> 'OTHER'), 0), 6) as "precision",
           round(coalesce(avg((predicted = label)::int) filter (where label <> 'OTHER'), 0), 6) as recall,
           round(avg((predicted = label)::int), 6) as accuracy from x""", x=LABELS)
def _(t):
    out = evaluation.scores(evaluation.confusion(t.view(LABELS), "label", "predicted"))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "recall", "accuracy")})


@query("family_scores", """
    select f as family, count(*) filter (where label = f) as support, count(*) filter (where predicted = f) as predicted,
           count(*) filter (where label = f and predicted = f) as correct from x, (values ('GOOD'), ('OTHER')) v(f) group by 1""", x=LABELS)
def _(t):
    out = evaluation.family_scores(evaluation.confusion(t.view(LABELS), "label", "predicted"))
    return out.select("family", "support", "predicted", "correct")


@query("reviewer_kappa", """
    with p as (select avg((label = second)::int) as po from x), n as (select count(*) as n from x),
         e as (select sum(a.c * b.c) / max(n.n * n.n) as pe from (select label as k, count(*) as c from x group by 1) a
               join (select second as k, count(*) as c from x group by 1) b using (k), n)
    select round(po, 6) as agreement, round((po - pe) / (1 - pe), 6) as kappa from p, e""", x=LABELS)
def _(t):
    out = evaluation.cohen_kappa(evaluation.confusion(t.view(LABELS), "label", "second"))
    return out.select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("partition_agreement", """
    with c as (select c_mktsegment as a, c_nationkey as b, count(*)::double as n from customer group by 1, 2),
         r as (select a, sum(n) as x from c group by 1), k as (select b, sum(n) as y from c group by 1), t as (select sum(n) as n from c),
         s as (select (select sum(n * (n - 1) / 2) from c) as cc, (select sum(x * (x - 1) / 2) from r) as rr, (select sum(y * (y - 1) / 2) from k) as kk,
                      (select n * (n - 1) / 2 from t) as nn, (select n from t) as n),
         h as (select (select -sum(x / t.n * ln(x / t.n)) from r, t) as ha, (select -sum(y / t.n * ln(y / t.n)) from k, t) as hb,
                      (select sum(c.n / t.n * ln(c.n * t.n / (r.x * k.y))) from c join r using (a) join k using (b), t) as mi)
    select round((cc - rr * kk / nn) / ((rr + kk) / 2 - rr * kk / nn), 6) as ari, round(mi / ((ha + hb) / 2), 6) as nmi from s, h""")
def _(t):
    out = evaluation.partition_agreement(t.customer, "c_mktsegment", "c_nationkey")
    return out.select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


@query("label_problems", """
    select cast(doc_id as varchar) as title, case when toxic = 1 then 'unknown family in reviewer_b' else 'no adjudicated label' end as problem
    from labels where toxic = 1 or quality = 0""")
def _(t):
    rows = t.labels.select(F.col("doc_id").cast("string").alias("title"), F.lit("LEGAL").alias("reviewer_a"),
                           F.when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 0, "OTHER").otherwise("LEGAL").alias("reviewer_b"),
                           F.lit("").alias("adjudicated"))
    return evaluation.label_problems(rows)


@query("title_clusters")
def _(t):
    """K-Means over unit TF-IDF vectors of part names; a fit has no SQL twin."""
    vectors = clustering.title_vectors(t.part, "p_name", "tokens")
    return clustering.top_titles(clustering.cluster(vectors, 8, 42), "p_name")


@query("empty_token_titles", "select count(*) as rows from (select trim(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g')) as c from documents) where regexp_matches(c, '\\s\\s') or c = ''")
def _(t):
    return clustering.empty_token_rows(t.documents, "text")


# --- snapshot profile -------------------------------------------------------------------------

CARDS = """
select c.c_mktsegment as job_title, case when c.c_acctbal >= 1000 then c.c_name end as company_name, n.n_name as location,
       o.o_orderstatus as job_type, 1 as salary_visible, cast(floor(o.o_totalprice) as bigint) as salary_min,
       cast(floor(o.o_totalprice + c.c_acctbal) as bigint) as salary_max
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
"""


@query("snapshot_leading_companies", "select company_name, count(*) as count from cards where company_name is not null group by 1 order by 2 desc, 1 limit 10", cards=CARDS)
def _(t):
    return snapshot.leading(t.view(CARDS), "company_name")


@query("snapshot_job_types", "select job_type, count(*) as count from cards group by 1", cards=CARDS)
def _(t):
    return snapshot.leading(t.view(CARDS), "job_type", None)


@query("snapshot_mean_pay", "select round(avg(salary_min), 2) as mean_min, round(avg(salary_max), 2) as mean_max from cards where salary_min > 0 and salary_max > 0", cards=CARDS)
def _(t):
    out = snapshot.mean_pay(t.view(CARDS))
    return out.select(F.round("mean_min", 2).alias("mean_min"), F.round("mean_max", 2).alias("mean_max"))


@query("equal_width_histogram", """
    with e as (select min(salary_min)::double as lo, max(salary_min)::double as hi from cards),
         b as (select least(floor((salary_min - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from cards, e group by 1)
    select i::int as bin, round(lo + i * (hi - lo) / 20, 4) as lower, round(lo + (i + 1) * (hi - lo) / 20, 4) as upper, coalesce(n, 0) as count
    from range(20) g(i) left join b on b.bin = g.i, e""", cards=CARDS)
def _(t):
    out = snapshot.equal_bins(t.view(CARDS), "salary_min")
    return out.withColumns({c: F.round(c, 4) for c in ("lower", "upper")})
