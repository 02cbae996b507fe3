"""Queries over the column functions: text, URLs, pay, attributes, titles, postings, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postlake.catalog.base import query
from postlake.functions import attributes, classify, jobs, jsonld, places, salary, text, titles, urls
from postlake.functions import snapshot as profile
from postlake.plans.silver import explode_postings, parse_captures
from postlake.session import checkpoint_dir, spread
from postlake.sources import feeds, publish, warc



def _decoded(value: str) -> str:
    """The entities the pages use, decoded once (the ampersand last)."""
    pairs = (("quot", "chr(34)"), ("copy", "'©'"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'"))
    for name, char in pairs:
        value = f"replace({value}, '&{name};', {char})"
    return value


@query("clean_text", r"""
    select doc_id, case when lower(c) in ('', '-', 'n/a', 'na', 'none', 'null', 'not specified') then null else c end as cleaned
    from (select doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x1c-\x1f\x0b]+', ' ', 'g')) as c from documents)""")
def _(t):
    return t.documents.select("doc_id", text.clean_text("text").alias("cleaned"))


@query("normalize_for_matching", """
    select conv_id, turn, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^0-9a-z+#]+', ' ', 'g')) as folded from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.normalize_for_matching("text").alias("folded"))


@query("description_text", r"""
    select page_id, length(d)::int as description_length, sha1(d) as description_sha1 from (
        select page_id, nullif(trim(regexp_replace(regexp_replace(html_unescape(html_unescape(html)), '<[^>]+>', ' ', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{85}\x1c-\x1f\x0b]+', ' ', 'g')), '') as d
        from (select page_id, html from pages))""".replace("html_unescape(html_unescape(html))", _decoded(_decoded("html"))))
def _(t):
    d = text.description_text("html")
    return t.pages.select("page_id", d.alias("d")).select(
        "page_id", F.length("d").alias("description_length"), F.sha1("d").alias("description_sha1"))


@query("canonical_page_urls", r"""
    select page_id, lower(regexp_extract(u, '^([^:]+:)', 1)) || '//' || lower(regexp_extract(u, '^[^:]+://([^/?#]*)', 1)) ||
           case when p = '' then '/' else p end || q as canonical_url
    from (select page_id, u, regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') as p, regexp_extract(u, '(\?[^#]+)', 1) as q
          from (select page_id, replace(url, 'http', 'HTTP') || case when url like '%#%' then '' else '/' end as u from pages))""")
def _(t):
    u = F.concat(F.replace("url", F.lit("http"), F.lit("HTTP")), F.when(F.col("url").contains("#"), "").otherwise("/"))
    return t.pages.select("page_id", urls.canonical_page_url(u).alias("canonical_url"))


@query("url_sites", r"""
    select page_id, regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[.]', '') as site,
           case when regexp_matches(split_part(lower(regexp_extract(url, '://(?:www[.])?([^/?#]+)', 1)), '.', 1), 'loker|lowongan|karir|career|kerja|jobs?|vacanc|rekrut|recruit|bursa|th')
                then 'job_site' else 'other' end as kind
    from (select page_id, url, regexp_replace(url, '://', '://User:pw@') as u from pages)""".replace("|bursa|th'", "|bursa'"))
def _(t):
    u = F.regexp_replace("url", "://", "://User:pw@")
    domain = urls.import_domain("url")
    return t.pages.select("page_id", urls.publisher_site(u).alias("site"), urls.site_type(domain).alias("kind"))


@query("validated_urls", "select page_id, case when page_id % 2 = 0 then url end as url from pages")
def _(t):
    given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("  "), F.col("url"))).otherwise(F.concat(F.lit("ftp:"), F.col("url")))
    return t.pages.select("page_id", urls.validated_url(given).alias("url"))


# --- pay, written from the part's size: the expected numbers follow by arithmetic --------------

_PAY = "p_partkey, p_size, p_type"


@query("parse_salary_text", """
    select p_partkey, case when p_size = 1 then 'NOT_DISCLOSED' when p_size = 2 then 'NEGOTIABLE' else 'DISCLOSED' end as status,
           cast(case when p_size <= 2 then null when p_type = 'ECONOMY' then p_size * 1000000 when p_type = 'SMALL' then p_size * 100000 + 50000 else p_size * 12000000 end as bigint) as minimum,
           cast(case when p_size <= 2 then null when p_type = 'ECONOMY' then (p_size + 2) * 1000000 when p_type = 'SMALL' then p_size * 100000 + 50000 else p_size * 24000000 end as bigint) as maximum,
           cast(case when p_size <= 2 then null when p_type in ('ECONOMY', 'SMALL') then
                case p_type when 'ECONOMY' then p_size * 1000000 else p_size * 100000 + 50000 end else p_size * 1000000 end as bigint) as monthly_minimum,
           case when p_size <= 2 then 'UNKNOWN' when p_type in ('ECONOMY', 'SMALL') then 'MONTH' else 'YEAR' end as period
    from part""")
def _(t):
    size = F.col("p_size").cast("string")
    pay = (
        F.when(F.col("p_size") == 1, "Gaji Tidak Ditampilkan").when(F.col("p_size") == 2, "nego")
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Rp "), size, F.lit(" - "), (F.col("p_size") + 2).cast("string"), F.lit(" juta")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("IDR "), F.regexp_replace(F.format_number(F.col("p_size") * 100000 + 50000, 0), ",", ".")))
        .otherwise(F.concat(F.lit("Rp "), (F.col("p_size") * 12).cast("string"), F.lit(" jt-"), (F.col("p_size") * 24).cast("string"), F.lit(" jt / tahun")))
    )
    out = t.part.select("p_partkey", salary.parse_salary(pay, "IDR", "MONTH").alias("s"))
    return out.select("p_partkey", *[F.col(f"s.{c}").alias(c) for c in ("status", "minimum", "maximum", "monthly_minimum", "period")])


@query("evaluate_salary_amounts", """
    select o_orderkey, case when lo <= 0 or hi <= 0 or lo > hi then 'INVALID' else 'DISCLOSED' end as status,
           case when lo <= 0 or hi <= 0 then '' when lo > hi then 'SALARY_MIN_GREATER_THAN_MAX' else concat_ws(',',
               case when hi > 4 * lo then 'SALARY_WIDE_RANGE' end, case when hi > 100000000 then 'SALARY_HIGH_OUTLIER' end,
               case when lo < 500000 then 'SALARY_LOW_OUTLIER' end) end as flags
    from (select o_orderkey, cast(floor(o_totalprice * 10 - 20000) as bigint) as lo, cast(floor(o_totalprice * 10 - 20000 + (o_totalprice - 200000) * 400) as bigint) as hi from orders)""")
def _(t):
    low = F.floor(F.col("o_totalprice") * 10 - 20000)
    high = F.floor(F.col("o_totalprice") * 10 - 20000 + (F.col("o_totalprice") - 200000) * 400)
    pay = salary.evaluate_amounts(low, high, F.lit("IDR"), F.lit("MONTH"))
    return t.orders.select("o_orderkey", pay.alias("s")).select(
        "o_orderkey", F.col("s.status").alias("status"), F.array_join("s.flags", ",").alias("flags"))


@query("yearly_pay_to_monthly", "select o_orderkey, cast(round_even(floor(o_totalprice) / 12.0, 0) as bigint) as monthly from orders")
def _(t):
    return t.orders.select("o_orderkey", salary.to_monthly(F.floor("o_totalprice"), F.lit("YEAR")).alias("monthly"))


# --- attributes ---------------------------------------------------------------------------------


@query("experience_from_text", """
    select l_orderkey, l_linenumber, case when l_quantity < 10 then q when l_quantity < 20 then 0 else q end as min_years,
           case when l_quantity < 10 then q + 2 when l_quantity < 20 then q end as max_years,
           case when l_quantity >= 10 and l_quantity < 20 then 'UNDER_1' when q < 3 then 'Y1_3' when q < 5 then 'Y3_5' when q < 10 then 'Y5_10' else 'OVER_10' end as band
    from (select *, cast(l_quantity as int) as q from lineitem)""")
def _(t):
    q = F.col("l_quantity").cast("int")
    said = (
        F.when(q < 10, F.concat((q + 2).cast("string"), F.lit(" – "), q.cast("string"), F.lit(" tahun")))
        .when(q < 20, F.concat(F.lit("Kurang dari "), q.cast("string"), F.lit(" tahun")))
        .otherwise(F.concat(F.lit("Minimal "), q.cast("string"), F.lit(" years")))
    )
    out = t.lineitem.select("l_orderkey", "l_linenumber", attributes.parse_experience(said).alias("e"))
    return out.select("l_orderkey", "l_linenumber", "e.*")


@query("posting_age_from_text", """
    select l_orderkey, l_linenumber, cast(l_quantity as int) * case l_returnflag when 'A' then 1 when 'R' then 7 else 30 end as days,
           l_linestatus = 'O' as is_urgent, l_returnflag <> 'A' as approximate from lineitem""")
def _(t):
    unit = F.when(F.col("l_returnflag") == "A", "hari").when(F.col("l_returnflag") == "R", "minggu").otherwise("bulan")
    said = F.concat(F.when(F.col("l_linestatus") == "O", "Urgent").otherwise(""), F.col("l_quantity").cast("int").cast("string"),
                    F.lit(" "), unit, F.lit(" yang lalu"))
    return t.lineitem.select("l_orderkey", "l_linenumber", attributes.parse_posting_age(said).alias("a")).select("l_orderkey", "l_linenumber", "a.*")


@query("employment_and_education", """
    select o_orderkey, case o_orderpriority when '1-URGENT' then 'FULL_TIME' when '2-HIGH' then 'PART_TIME' when '3-MEDIUM' then 'CONTRACT' when '5-LOW' then 'INTERNSHIP' else 'UNKNOWN' end as employment,
           case o_orderstatus when 'F' then 'BACHELOR' when 'O' then 'SMA_SMK' else 'UNKNOWN' end as education from orders""")
def _(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    label = (F.when(p == "1-URGENT", "Penuh-Waktu").when(p == "2-HIGH", "PART TIME (shift)").when(p == "3-MEDIUM", "Kontrak 1 tahun")
             .when(p == "5-LOW", "Magang").otherwise("lainnya"))
    school = F.when(s == "F", "Minimal Sarjana (S1)").when(s == "O", "min. SMA/SMK").otherwise("asdsd")
    return t.orders.select("o_orderkey", attributes.employment_type(label).alias("employment"), attributes.education_level(school).alias("education"))


@query("card_tags_split", """
    select o_orderkey, concat_ws(',', case when o_orderstatus = 'F' then 'SQL' end, o_orderpriority) as skills,
           case when o_totalprice > 200000 then 3 else 0 end as hidden_count, case when o_totalprice > 300000 then 'REMOTE' else 'UNKNOWN' end as work_arrangement
    from orders""")
def _(t):
    tags = F.array(F.when(F.col("o_orderstatus") == "F", " SQL "), F.col("o_orderpriority"), F.when(F.col("o_totalprice") > 200000, "+3"),
                   F.when(F.col("o_totalprice") > 300000, "Remote/Dari rumah"), F.lit("Perusahaan Premium"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", attributes.split_card_tags(tags).alias("c")).select(
        "o_orderkey", F.array_join("c.skills", ",").alias("skills"), F.col("c.hidden_count").alias("hidden_count"),
        F.col("c.work_arrangement").alias("work_arrangement"))


# --- places, titles, roles, skills ----------------------------------------------------------------

_WHERE = "case n_regionkey when 0 then 'Bandung' when 1 then 'Surabaya' when 2 then 'Jakarta' when 3 then 'Singapura' else 'Medan' end"


@query("location_parse", f"""
    select c_custkey, case when w = 'Jakarta' then null else 'Kabupaten ' || w end as city,
           case w when 'Bandung' then 'Jawa Barat' when 'Surabaya' then 'Jawa Timur' when 'Jakarta' then 'DKI Jakarta' when 'Medan' then 'Sumatera Utara' end as province,
           case w when 'Jakarta' then 'SOURCE_STRUCTURED' when 'Singapura' then 'UNKNOWN' else 'INFERRED' end as confidence
    from (select c_custkey, {_WHERE} as w from customer join nation on c_nationkey = n_nationkey)""")
def _(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_WHERE).alias("w"))
    said = F.when(F.col("w") == "Jakarta", "Jakarta").otherwise(F.concat(F.lit("Kab. "), F.col("w")))
    return c.select("c_custkey", places.parse_location(said).alias("l")).select("c_custkey", "l.city", "l.province", "l.confidence")


@query("title_keys", """
    select p_partkey, p_name as title_key, upper(p_name[1]) || p_name[2:] as display_title from part""")
def _(t):
    said = F.concat(F.lit("Lowongan Kerja "), F.col("p_name"), F.lit(" (Lamar Sekarang) - Bisa Kerja"))
    long = F.concat(F.lit("Loker "), F.col("p_name"), F.lit(" PT Maju Abadi Bandung tahun 2025"))
    return t.part.select("p_partkey", titles.title_key(long, F.lit("PT Maju Abadi"), F.lit("Bandung")).alias("title_key"),
                         titles.display_title(said, F.lit("PT Maju")).alias("display_title"))


@query("employer_keys", "select s_suppkey, lower(regexp_replace(s_name, '#', ' # ')) as organization_key, s_nationkey = 3 as placeholder from supplier".replace(
    "lower(regexp_replace(s_name, '#', ' # '))", "lower(s_name)"))
def _(t):
    name = F.concat(F.lit("PT. "), F.col("s_name"), F.lit(", Tbk"))
    shown = F.when(F.col("s_nationkey") == 3, "Lokercontoh Jobs").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", titles.organization_key(name).alias("organization_key"),
                             titles.is_placeholder_employer(shown, F.lit("lokercontoh.id")).alias("placeholder"))


@query("role_families", """
    select o_orderkey, case o_orderpriority when '1-URGENT' then 'DATA_ANALYTICS' when '2-HIGH' then 'SUPPLY_CHAIN' when '3-MEDIUM' then 'ENGINEERING'
           when '5-LOW' then 'FOOD_HOSPITALITY' else 'OTHER' end as role_family from orders""")
def _(t):
    p = F.col("o_orderpriority")
    title = (F.when(p == "1-URGENT", "Sr. Data Engineer").when(p == "2-HIGH", "Admin Gudang").when(p == "3-MEDIUM", "Production Engineer")
             .when(p == "5-LOW", "Cook Helper").otherwise("Master of Ceremony"))
    return t.orders.select("o_orderkey", classify.role_family(F.concat(title, F.lit(" "), F.col("o_orderstatus"))).alias("role_family"))


WORDS = (("the", "the", "the"), ("on", "on(?!e)", "on"), ("les", "les|la", "les;la"), ("der", "der", "der"), ("para", "para", "para"))


@query("dictionary_mentions", "select doc_id, concat_ws(',', " + ", ".join(
    f"case when regexp_matches(lower(text), '(^|[^\\w.+#\\x{{80}}-\\x{{10ffff}}])(?:{p.replace('(?!e)', '')})([^\\w+#\\x{{80}}-\\x{{10ffff}}]|$)') then '{n}' end"
    for n, p, _ in WORDS) + ") as words from documents")
def _(t):
    ascii_edges = F.regexp_replace(F.lower("text"), "[\\x{80}-\\x{10ffff}]", "x")
    return t.documents.select(
        "doc_id", F.array_join(classify.extract_skills(ascii_edges, WORDS, ()), ",").alias("words"))


@query("skill_mentions", "select doc_id, case when n_chars > 300 then 'Java,C++,Microsoft Excel,English' else 'JavaScript,React Native' end as skills from documents")
def _(t):
    added = F.when(F.col("n_chars") > 300, ". Menguasai Java, C++ dan MS Excel; lulusan S1 Akuntansi. Bahasa Inggris aktif").otherwise(
        ". javascript developer, React Native, S1 bidang Komunikasi")
    return t.documents.select(
        "doc_id", F.array_join(classify.extract_skills(F.concat("text", added)), ",").alias("skills"))


@query("job_fingerprints", """
    select o_orderkey, sha256(lower(replace(o_orderpriority, '-', ' ')) || '|' || lower(c_mktsegment) || '|' || lower(o_orderstatus)) as fingerprint
    from orders join customer on o_custkey = c_custkey""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", jobs.job_fingerprint("o_orderpriority", "c_mktsegment", "o_orderstatus").alias("fingerprint"))


@query("content_hashes", """
    select o_orderkey, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') as content_hash from orders""")
def _(t):
    raw = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", jobs.content_hash(raw).alias("content_hash"))


# --- pages, postings, feeds -----------------------------------------------------------------------

_CITY = "case n_regionkey when 0 then 'Bandung' when 1 then 'Surabaya' when 2 then 'Medan' when 3 then 'Kab. Bogor' else 'Jakarta Selatan' end"


def _posting_rows(t):
    """Orders as JobPosting objects: the employer is the customer, pay follows the price."""
    rows = (spread(t.orders).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")))
    pay = F.struct(F.lit("Rp").alias("currency"), F.struct(
        F.floor("o_totalprice").alias("minValue"), (F.floor("o_totalprice") * 2).alias("maxValue"), F.lit("MONTH").alias("unitText")).alias("value"))
    address = F.struct(F.expr(_CITY).alias("addressLocality"), F.lit("ID").alias("addressCountry"))
    posting = F.struct(
        F.lit("JobPosting").alias("@type"),
        F.concat(F.lit("Lowongan Kerja Kasir &amp; Admin "), F.col("o_orderpriority")).alias("title"),
        F.struct(F.col("c_name").alias("name")).alias("hiringOrganization"), F.struct(address.alias("address")).alias("jobLocation"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("datePosted"),
        F.when(F.col("o_orderstatus") == "F", "FULL_TIME").otherwise("INTERN").alias("employmentType"), pay.alias("baseSalary"))
    return rows.select("o_orderkey", "o_orderdate", F.to_json(posting).alias("posting"))


def _pages(t):
    rows = _posting_rows(t)
    block = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), F.col("posting"),
                     F.lit(']}</script><script type="application/ld+json">{bad</script></html>'))
    return rows.withColumn("html", block)


@query("jsonld_postings", """
    select o_orderkey, 1 as postings, 1 as malformed, c_name as employer from orders join customer on o_custkey = c_custkey""")
def _(t):
    found = _pages(t).select("o_orderkey", jsonld.extract_job_postings("html").alias("j"))
    return found.select("o_orderkey", F.size("j.postings").alias("postings"), "j.malformed",
                        F.get_json_object(F.get("j.postings", 0), "$.hiringOrganization.name").alias("employer"))


@query("posting_observations", f"""
    select 'https://site.id/' || o_orderkey || '#0' as source_record_key, 'Kasir & Admin ' || o_orderpriority as title,
           c_name as organization, lower(c_name) as organization_key, replace(w, 'Kab. ', 'Kabupaten ') as city,
           case w when 'Bandung' then 'Jawa Barat' when 'Surabaya' then 'Jawa Timur' when 'Medan' then 'Sumatera Utara' when 'Kab. Bogor' then 'Jawa Barat' else 'DKI Jakarta' end as province,
           case o_orderstatus when 'F' then 'FULL_TIME' else 'INTERNSHIP' end as employment_type,
           case when cast(o_orderdate as date) < date '2010-01-01' then null else cast(o_orderdate as date) end as date_posted,
           case when floor(o_totalprice) > 0 then 'DISCLOSED' else 'INVALID' end as salary_status,
           cast(floor(o_totalprice) as bigint) as salary_monthly_min, cast(floor(o_totalprice) * 2 as bigint) as salary_monthly_max, true as is_valid
    from (select *, {_CITY} as w from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)""")
def _(t):
    empty = F.lit(None)
    captures = _posting_rows(t).select(
        F.lit("c1").alias("crawl"), F.concat(F.lit("https://Site.id/"), F.col("o_orderkey"), F.lit("/#x")).alias("url"), F.lit("site.id").alias("domain"),
        F.col("o_orderdate").cast("timestamp").alias("captured_at"), F.lit("f").alias("bronze_file"), F.lit("feed").alias("registry_source_id"),
        empty.cast("string").alias("warc_filename"), empty.cast("bigint").alias("warc_record_offset"), F.lit("d").alias("content_digest"),
        F.lit("ok").alias("fetch_result"), F.concat(F.lit("["), F.col("posting"), F.lit("]")).alias("postings_json"))
    return parse_captures(captures).select(
        "source_record_key", "title", "organization", "organization_key", "city", "province", "employment_type", "date_posted",
        "salary_status", "salary_monthly_min", "salary_monthly_max", "is_valid")


@query("postings_by_position", """
    select user_id, cast(ts as date) as day, cast(row_number() over (partition by user_id, cast(ts as date) order by event_id) - 1 as int) as position, event_id
    from events""")
def _(t):
    listed = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.array_sort(F.collect_list("event_id"))).alias("postings_json"))
    out = explode_postings(listed.withColumn("fetch_result", F.lit("ok")))
    return out.select("user_id", "day", "position", F.col("posting").cast("bigint").alias("event_id"))


@query("feed_lines_validated", """
    select case when k % 4 = 1 then 'missing or invalid url' when k % 4 = 2 then 'missing captured_at' when k % 4 = 3 then 'line is not a JSON object' end as reject_reason,
           case when k % 4 = 0 then 'host' || o_custkey || '.example' end as domain, count(*) as lines
    from (select o_orderkey as k, o_custkey from orders) group by 1, 2""")
def _(t):
    k = F.col("o_orderkey") % 4
    url = F.concat(F.lit("https://www.host"), F.col("o_custkey"), F.lit(".example/"), F.col("o_orderkey"))
    line = (F.when(k == 0, F.to_json(F.struct(url.alias("url"), F.lit("2026-09-02T00:00:00Z").alias("captured_at"), F.col("o_orderpriority").alias("title"))))
            .when(k == 1, F.to_json(F.struct(F.lit("no-url").alias("url"), F.lit("2026-09-02T00:00:00Z").alias("captured_at"))))
            .when(k == 2, F.to_json(F.struct(url.alias("url")))).otherwise("[1, 2]"))
    rows = feeds.validate_lines(t.orders.select(line.alias("value")), "licensed")
    return rows.groupBy("reject_reason", "domain").agg(F.count("*").alias("lines"))


@query("board_payload_jobs", """
    select cast(o_orderkey as varchar) as source_key, o_orderpriority as title, cast(floor(o_totalprice) as bigint) as minimum,
           case o_orderstatus when 'F' then 'YEAR' when 'O' then 'MONTH' else 'UNKNOWN' end as period, cast(o_orderdate as date) as published
    from orders""")
def _(t):
    interval = F.when(F.col("o_orderstatus") == "F", "per-year-salary").when(F.col("o_orderstatus") == "O", "per-month-salary").otherwise("other")
    payload = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"),
        F.struct(F.lit("IDR").alias("currency"), interval.alias("interval"), F.floor("o_totalprice").alias("min"), F.floor("o_totalprice").alias("max")).alias("salaryRange"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createdAt")))
    out = feeds.board_source_jobs(t.orders.select(payload.alias("value")), "PT Contoh")
    return out.select("source_key", "title", "structured_salary.minimum", "structured_salary.period", F.to_date("published_at").alias("published"))


@query("serving_jobs_normalized", """
    select cast(o_orderkey as varchar) as source_key, 'Kasir ' || o_orderstatus as title, 'RETAIL_STORE' as role_family, c_mktsegment as company_name,
           'Bandung' as city, 'Jawa Barat' as province, 'FULL_TIME' as employment_type, 'DISCLOSED' as salary_status,
           cast(p as bigint) * 1000000 as salary_monthly_min, cast(p + 2 as bigint) * 1000000 as salary_monthly_max,
           concat_ws(',', case when p > 100 then null end, case when p + 2 > 100 then 'SALARY_HIGH_OUTLIER' end, 'SALARY_PERIOD_ASSUMED', case when p + 2 > 4 * p then 'SALARY_WIDE_RANGE' end) as quality_flags
    from (select *, floor(o_totalprice / 10000) + 1 as p from orders join customer on o_custkey = c_custkey)""")
def _(t):
    p = F.floor(F.col("o_totalprice") / 10000) + 1
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("source_key"), F.concat(F.lit(" Kasir  "), F.col("o_orderstatus")).alias("title"),
        F.col("c_mktsegment").alias("company_name"), F.lit("Bandung,Jawa Barat").alias("location_text"),
        F.concat(F.lit("Rp "), p.cast("string"), F.lit(" jt-"), (p + 2).cast("string"), F.lit(" jt")).alias("salary_text"),
        F.lit("Penuh Waktu").alias("employment_type_text"), F.array(F.lit("Excel")).alias("tags"))
    out = jobs.normalize_source_jobs(rows, "IDR", "MONTH")
    return out.select("source_key", "title", "role_family", "company_name", "city", "province", "employment_type", "salary_status",
                      "salary_monthly_min", "salary_monthly_max", F.array_join("quality_flags", ",").alias("quality_flags"))


@query("deadline_end_of_day", """
    select o_orderkey, strftime(cast(cast(o_orderdate as date) as timestamp) + interval '16:59:59' hour to second, '%Y-%m-%d %H:%M:%S') as expires
    from orders""".replace("interval '16:59:59' hour to second", "interval '60  ' second * 1019 + interval '59' second".replace("60  ", "60")))
def _(t):
    return t.orders.select("o_orderkey", F.date_format(publish.end_of_day(F.to_date("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("snapshot_features", """
    select o_orderkey, n_name as city, 'Banten' as province, case when o_orderstatus = 'P' then 0 else 1 end as salary_visible,
           case when o_orderstatus = 'P' then 0 else cast(floor(o_totalprice / 10000) + 1 as bigint) * 1000000 end as salary_min
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    pay = F.when(F.col("o_orderstatus") == "P", "Tidak Ditampilkan").otherwise(
        F.concat(F.lit("Rp "), (F.floor(F.col("o_totalprice") / 10000) + 1).cast("string"), F.lit(" jt-99 jt")))
    cards = rows.select("o_orderkey", F.lit("Kasir").alias("job_title"), F.concat("n_name", F.lit(", Banten")).alias("location"),
                        pay.alias("salary_range"), F.lit("Not Specified").alias("job_requirements"))
    return profile.snapshot_features(cards).select("o_orderkey", "city", "province", "salary_visible", "salary_min")


@query("archived_pages", """
    select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[.]', '') as domain,
           sha1(html) as body_sha1 from pages""")
def _(t):
    """Pages as archive files of many response records, half of them gzipped, read back by ranges.

    The stated digest holds the page id."""
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 2031-02-03T04:05:06Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: page:"), F.col("page_id").cast("string"),
        F.lit("\r\nContent-Length: "), F.octet_length(message).cast("string"), F.lit("\r\n\r\n"), message)
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/archived-pages-{uuid.uuid4().hex}"
    for k, coding in enumerate(("none", "gzip")):
        t.pages.filter(F.pmod("page_id", F.lit(2)) == k).select(record.alias("value")).write.option(
            "lineSep", "\r\n\r\n").text(f"{path}/{coding}", compression=coding)
    return warc.read_warc(t.spark, f"{path}/*").select(
        F.col("content_digest").cast("bigint").alias("page_id"), "url", "domain", F.sha1(F.col("body").cast("binary")).alias("body_sha1"))
