"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import (
    decontamination, licenses, line_dedup, lm_scoring, ngram_jaccard, quality_classifier, quality_rules, reversed_search,
    sentencepieces, toxicity, url_filters, va_clustering, warc,
)
from postlake.llm.stage import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def piece_model() -> str:
    """The public 32k piece model of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    return warc.resolve_revisits(warc.read_warc(spark, path))


SQL["op1_warc"] = """
with payloads as (
    select page_id, coalesce(html, '') as html from pages
), digests as (
    select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from payloads
), kept as (
    select *, max(page_id) over (partition by payload_digest, payload_bytes) as keeper from digests
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < keeper then keeper end as refers_to
from kept
"""


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


@query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.encode_documents(table(spark, folder, "documents"), piece_model())


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, folder, "labels"), "quality"))


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.url_filter(table(spark, folder, "pages"))


SQL["op7_url_filter"] = r"""
with cut as (
    select page_id,
           case when strpos(coalesce(url, ''), '://') = 0 then ''
                else regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') end as rest
    from pages
), parts as (
    select page_id,
           translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path
    from cut
), ruled as (
    select *,
           case when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
                when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
                when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
                when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule,
           list_filter(list_value(
               case when ('.' || host) like '%.spam%' then '*.spam*#*' end,
               case when ('.' || host) like '%-spam.%' then '*-spam.*#*' end,
               case when host like '%casino%' then '*casino*#*' end,
               case when ('.' || host) like '%.adult.%' then '*.adult.*#*' end,
               case when ('.' || host) like '%.xxx' then '*.xxx#*' end,
               case when host like '%phish%' then '*phish*#*' end,
               case when path like '%/wp-login%' then '*#*/wp-login*' end,
               case when path like '%/doorway/%' then '*#*/doorway/*' end,
               case when path like '%/cgi-bin/%' then '*#*/cgi-bin/*' end), lambda x: x is not null) as method_globs
    from parts
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when len(method_globs) > 0 then 'block' else 'allow' end as verdict,
       method_globs
from ruled
"""


@query
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"))


SQL["op8_lm_scoring"] = r"""
with words as (
    select row_number() over () as row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x20\x09-\x0D]+') as w
    from documents
), placed as (
    select row_id, unnest(w) as c, generate_subscripts(w, 1) as i from words
), runs as (
    select row_id, i, c, lag(c, 1) over (partition by row_id order by i) as b, lag(c, 2) over (partition by row_id order by i) as a from placed
), one as (
    select c, count(*) as n from runs group by c
), two as (
    select b, c, count(*) as n from runs where b is not null group by b, c
), three as (
    select a, b, c, count(*) as n from runs where a is not null group by a, b, c
), scored as (
    select runs.row_id,
           case when three.n >= 2 then ln(three.n / context.n)
                when two.n >= 2 then ln(two.n / before.n) + (least(i, 3) - 2) * ln(0.4)
                else ln(one.n / (select count(*) from runs)) + (least(i, 3) - 1) * ln(0.4) end as s
    from runs join one on runs.c = one.c
    left join one before on runs.b = before.c
    left join two on runs.b = two.b and runs.c = two.c
    left join two context on runs.a = context.b and runs.b = context.c
    left join three on runs.a = three.a and runs.b = three.b and runs.c = three.c
), sums as (
    select row_id, sum(s) as s from scored group by row_id
)
select doc_id, cast(len(w) as bigint) as n_words, round(coalesce(s, 0), 6) as log_score,
       round(case when len(w) > 0 then s / len(w) else 0 end, 6) as mean_log_score
from words left join sums using (row_id)
"""


@query
def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, folder, "documents"))


SQL["op9_ngram_jaccard"] = r"""
with recursive words as (
    select doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select doc_id,
           case when len(w) = 0 then cast([] as varchar[]) when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from words
), sized as (
    select doc_id, len(s) as n, s from shingles
), postings as (
    select doc_id, n, unnest(s) as shingle from sized
), pairs as (
    select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as common
    from postings a join postings b on a.shingle = b.shingle and a.doc_id <> b.doc_id and 100 * a.n >= 75 * b.n and 100 * b.n >= 75 * a.n
    group by all
), links as (
    select a, b from pairs where 100 * common >= 75 * (na + nb - common)
), reach(doc_id, other) as (
    select doc_id, doc_id from sized
    union
    select reach.doc_id, links.b from reach join links on reach.other = links.a
)
select sized.doc_id, cast(n as bigint) as n_shingles, component_id
from sized join (select doc_id, min(other) as component_id from reach group by doc_id) using (doc_id)
"""


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, folder, "documents"), trusted)


@query
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op11_line_dedup"] = r"""
with texts as (
    select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), placed as (
    select row_id, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as position from texts
), keyed as (
    select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from placed
), frequent as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
    select keyed.*, frequent.key is not null and keyed.doc_id <> frequent.keeper as gone
    from keyed left join frequent on keyed.key = frequent.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by position) filter (where not gone), '')) as kept_sha256
from marked group by row_id, doc_id
"""


@query
def op12_reversed_search(spark: SparkSession, folder: str) -> DataFrame:
    return reversed_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_reversed_search"] = r"""
with texts as (
    select row_number() over () as row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), totals as (
    select count(*) as docs, cast(sum(len(terms)) as bigint) as all_terms from texts where len(terms) > 0
), wanted as (
    select row_number() over () as item, item_id,
           list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms
    from benchmark
), postings as (
    select item, item_id, unnest(terms) as term from wanted
), occurrences as (
    select row_id, doc_id, len(terms) as n, unnest(terms) as term from texts
), counts as (
    select row_id, doc_id, n, term, count(*) as tf from occurrences where term in (select term from postings) group by all
), weights as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from counts, totals group by term, docs
), scored as (
    select item, item_id, row_id, doc_id,
           cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // all_terms)))) as bigint) as score
    from counts join weights using (term) join postings using (term), totals group by all
), ranked as (
    select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


@query
def op13_va_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return va_clustering.cluster_report(table(spark, folder, "embeddings"))


def _rounds_sql(rounds: int = 3) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of the rounds, as common table expressions."""
    assigned = """a{r} as materialized (
    select vec_id, row_id, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from (
        select p.vec_id, p.row_id, c.cluster, cast(sum((p.x - c.x) * (p.x - c.x)) as bigint) as distance
        from placed p join c{r} c using (d) group by p.vec_id, p.row_id, c.cluster) group by vec_id, row_id
)"""
    moved = """c{n} as materialized (
    select c.cluster, c.d, coalesce(m.x, c.x) as x from c{r} c left join (
        select a.cluster, p.d, cast(floor(cast(sum(p.x) as double) / count(*)) as bigint) as x
        from placed p join a{r} a using (row_id) group by a.cluster, p.d) m on m.cluster = c.cluster and m.d = c.d
)"""
    parts = [part.format(r=r, n=r + 1) for r in range(rounds) for part in (assigned, moved)]
    return ",\n".join([*parts, assigned.format(r=rounds)])


SQL["op13_va_clustering"] = f"""
with kept as materialized (
    select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as whole
    from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), placed as materialized (
    select row_id, vec_id, unnest(whole) as x, generate_subscripts(whole, 1) as d from kept
), first as (
    select row_number() over (order by hash, vec_id, whole) - 1 as cluster, whole from (
        select vec_id, whole, sha256('1:' || vec_id) as hash from kept order by hash, vec_id, whole limit 16)
), c0 as (
    select cluster, unnest(whole) as x, generate_subscripts(whole, 1) as d from first
), {_rounds_sql()}
select a.vec_id, cast(a.cluster as integer) as cluster, a.distance, s.cluster_inertia, cast(t.inertia as bigint) as inertia, g.centroid_sha256
from a3 a
join (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a3 group by cluster) s using (cluster)
join (select cluster, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from c3 group by cluster) g using (cluster),
(select sum(distance) as inertia from a3) t
"""
