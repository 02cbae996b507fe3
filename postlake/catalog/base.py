"""Registry, table access and the column mappings shared by a query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The Parquet tables of one folder as attributes, and the derived views by SQL text."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        """A mapping written once for both engines, here in Spark's dialect."""
        used = {t: getattr(self, t) for t in TABLES if f"{{{t}}}" in text}
        for token, (here, _) in DIALECT.items():
            text = text.replace(token, here)
        return self.spark.sql(text, **used)


# token -> (Spark, DuckDB)
DIALECT = {
    "@list(": ("filter(array(", "list_filter(list_value("),
    "@end": ("), x -> x is not null)", "), lambda x: x is not null)"),
    "@string": ("string", "varchar"),
    "@day(": ("date(", "date("),
}


def twin(text: str) -> str:
    """The mapping in DuckDB's dialect, reading the registered views."""
    for token, (_, there) in DIALECT.items():
        text = text.replace(token, there)
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def query(name: str, sql: str | None = None, **views: str):
    """Register ``build(tables)``; ``views`` become WITH clauses in front of the SQL."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            heads = ", ".join(f"{n} as ({twin(text)})" for n, text in views.items())
            body = twin(sql).strip()
            start = "with recursive " if body.startswith("with recursive ") else "with "
            if heads and body.startswith(start):
                SQL[name] = f"{start}{heads}, {body[len(start):]}"
            else:
                SQL[name] = f"with {heads} {body}" if heads else body
        return build

    return register


# Orders as serving jobs. Missing values and codes follow real columns of the order and its
# customer, so every rule meets both of its sides.
JOBS = """
select o.o_orderkey as id,
       concat(c.c_mktsegment, ' ', o.o_orderpriority) as title,
       case when c.c_acctbal >= 500 then c.c_name end as company_name,
       case when c.c_acctbal >= 0 then n.n_name end as city,
       r.r_name as province,
       c.c_mktsegment as role_family,
       o.o_orderpriority as employment_type,
       case o.o_orderstatus when 'F' then 'REMOTE' when 'O' then 'HYBRID' else 'UNKNOWN' end as work_arrangement,
       case when c.c_acctbal < 1000 then 'UNKNOWN' when c.c_acctbal < 4000 then 'DIPLOMA' else 'BACHELOR' end
           as education_level,
       case when o.o_totalprice < 50000 then 'UNKNOWN' when o.o_totalprice < 200000 then 'Y1_3' else 'Y5_10' end
           as experience_band,
       n.n_name as primary_source_id,
       case o.o_orderstatus when 'P' then 'NOT_DISCLOSED' else 'DISCLOSED' end as salary_status,
       case o.o_orderpriority when '1-URGENT' then 'USD' else 'IDR' end as salary_currency,
       cast(floor(o.o_totalprice) * 40 as bigint) as salary_monthly_min,
       cast(floor(o.o_totalprice) * 40 + floor(c.c_acctbal - 1500) * 500 as bigint) as salary_monthly_max,
       o.o_orderpriority = '2-HIGH' as salary_period_assumed,
       @list(case when c.c_acctbal > 8000 then 'SALARY_WIDE_RANGE' end,
             case when o.o_totalprice > 400000 then 'SALARY_HIGH_OUTLIER' end,
             case when o.o_totalprice < 20000 then 'SALARY_LOW_OUTLIER' end @end as quality_flags,
       @list(case when o.o_orderstatus = 'F' then 'sql' end, case when c.c_acctbal > 5000 then 'python' end,
             case when o.o_orderpriority = '5-LOW' then 'excel' end @end as source_tags,
       case when o.o_orderstatus = 'O' and o.o_totalprice > 300000 then 2 else 0 end as hidden_tag_count,
       case when c.c_acctbal >= 0
            then concat('https://www.', lower(c.c_mktsegment), '.example.com/job/', o.o_orderkey) end as source_url,
       case when o.o_orderstatus <> 'P' then cast(o.o_orderdate as timestamp) end as published_at,
       cast(o.o_orderdate as timestamp) + interval '20' day as last_seen_at,
       case when o.o_orderstatus = 'F' then cast(o.o_orderdate as timestamp) + interval '45' day end as expires_at,
       cast(length(c.c_mktsegment) as int) as posted_age_days,
       lower(concat(c.c_mktsegment, ' ', o.o_orderpriority, ' ', c.c_name, ' ', n.n_name)) as search_text,
       concat(c.c_name, '|', o.o_orderpriority) as fingerprint
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
     join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
"""
# Nations as registered sources, with orders as their runs.
SOURCES = """
select n.n_name as id, concat('Source ', n.n_name) as name,
       case when r.r_name = 'ASIA' then null else concat('notes on ', n.n_name) end as coverage_note,
       case r.r_name when 'EUROPE' then 'BLOCKED' when 'ASIA' then 'APPROVED' else 'APPROVED_WITH_CONDITIONS' end
           as permission_status,
       case when n.n_nationkey < 20 then 'feed' end as connector, n.n_nationkey < 3 as is_paused,
       case when n.n_nationkey <> 7 then timestamp '2000-01-01 00:00:00' + interval '30' day * n.n_nationkey end
           as reviewed_at
from {nation} n join {region} r on n.n_regionkey = r.r_regionkey
"""
RUNS = """
select n.n_name as source_id, case o.o_orderstatus when 'F' then 'SUCCEEDED' when 'O' then 'FAILED' else 'PARTIAL' end
       as status, cast(o.o_orderdate as timestamp) + interval '1' second * o.o_orderkey as started_at,
       cast(o.o_orderdate as timestamp) + interval '1' day as finished_at
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
"""
AS_OF = "2000-06-01 00:00:00"
COMPARABLE = (
    "salary_status = 'DISCLOSED' and salary_currency = 'IDR' and salary_monthly_min <= salary_monthly_max "
    "and (salary_monthly_min + salary_monthly_max) / 2.0 >= 500000"
)
MIDPOINT = "(salary_monthly_min + salary_monthly_max) / 2.0"
LIFECYCLE = (
    f"case when expires_at < timestamp '{AS_OF}' then 'EXPIRED_BY_SOURCE' "
    f"when last_seen_at >= timestamp '{AS_OF}' - interval '30' day then 'POTENTIALLY_ACTIVE' "
    "else 'NOT_SEEN_RECENTLY' end"
)
HOST = "regexp_replace(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[.]', '')"
