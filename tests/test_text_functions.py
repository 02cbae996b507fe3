import html
import random
import unicodedata
from html import entities

import pytest
from pyspark.sql import functions as F

from postlake.functions import attributes, classify, jsonld, places, salary, text, titles, urls


def test_clean_text(evaluate):
    cases = {
        None: None, "": None, "   ": None, "Not Specified": None, "-": None, "N/A": None,
        "  Rp 7\xa0jt \n -  9 jt ": "Rp 7 jt - 9 jt", "1–3 tahun": "1–3 tahun",
        "Ｆｕｌｌ １２": "Full 12", "café": "café",
    }
    assert evaluate(text.clean_text("v"), list(cases)) == list(cases.values())


def test_matching_form_equals_the_unicode_definition(evaluate):
    rng = random.Random(3)
    alphabet = "aB3 +#.,-éÉßøłŁñçİıſæœĳŉ０ａﬁ²½™Ωжא中–“”…̧́ǆẞẍ"
    samples = ["".join(rng.choices(alphabet, k=12)) for _ in range(400)]
    samples += ["C++ Software Engineer", "Café Supervisor", "((()))", "[INTERN] Backend (.NET)"]

    def expected(value):
        parts = unicodedata.normalize("NFKD", value)
        folded = "".join(c for c in parts if not unicodedata.combining(c)).casefold()
        return " ".join("".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz+#" else " " for c in folded).split())

    assert evaluate(text.normalize_for_matching("v"), samples) == [expected(s) for s in samples]
    nfkc = [unicodedata.normalize("NFKC", s.replace("\xa0", " ")) for s in samples]
    assert evaluate(text.nfkc("v"), samples) == nfkc


def test_entities_and_mojibake(evaluate):
    got = evaluate(text.repair_mojibake(text.unescape_html("v")),
                   ["Barista &#8211; Full &amp; Part", "YANTI â€“ BOGOR", "Kue – Bogor", None])
    assert got == ["Barista – Full & Part", "YANTI – BOGOR", "Kue – Bogor", None]
    assert evaluate(text.description_text("v"), ["<p>A &amp;amp; <b>B</b></p>", "<br>", None]) == [
        "A & B", None, None]


@pytest.mark.parametrize("value, city, province, confidence, regency", [
    ("Kab. Tangerang,Banten", "Kabupaten Tangerang", "Banten", "SOURCE_STRUCTURED", True),
    ("KAB Bandung, Jawa Barat", "Kabupaten Bandung", "Jawa Barat", "SOURCE_STRUCTURED", True),
    ("Kota Bogor, Jawa Barat", "Kota Bogor", "Jawa Barat", "SOURCE_STRUCTURED", False),
    ("Yogyakarta,DI Yogyakarta", "Yogyakarta", "DI Yogyakarta", "SOURCE_STRUCTURED", None),
    ("DKI Jakarta, DKI Jakarta", None, "DKI Jakarta", "SOURCE_STRUCTURED", None),
    ("Provinsi Jawa Barat", None, "Jawa Barat", "SOURCE_STRUCTURED", None),
    ("Kota Bekasi", "Kota Bekasi", "Jawa Barat", "INFERRED", False),
    ("Singapore", "Singapore", None, "UNKNOWN", None),
    ("Remote", None, None, "UNKNOWN", None),
    (None, None, None, "UNKNOWN", None),
])
def test_location(evaluate, value, city, province, confidence, regency):
    [row] = evaluate(places.parse_location("v"), [value])
    assert (row.city, row.province, row.confidence, row.is_regency) == (city, province, confidence, regency)
    assert row.is_remote == (value == "Remote")


def test_province_spellings(evaluate):
    cases = {"Jakarta": "DKI Jakarta", "D.I. Yogyakarta": "DI Yogyakarta", "jatim": "Jawa Timur",
             "Atlantis": None, None: None}
    assert evaluate(places.canonical_province("v"), list(cases)) == list(cases.values())


def test_address_parts(evaluate):
    cases = {
        ("Jakarta, Daerah Khusus Ibukota Jakarta, Indonesia", None): (None, "DKI Jakarta"),
        ("Kabupaten Sukoharjo", "Jawa Tengah"): ("Kabupaten Sukoharjo", "Jawa Tengah"),
        ("Seluruh Indonesia", None): (None, None),
        ("Kota Bekasi", None): ("Kota Bekasi", "Jawa Barat"),
        (None, None): (None, None),
        ("Medan, Sumatra Utara", None): ("Medan", "Sumatera Utara"),
        ("Kalideres", None): ("Kalideres", "DKI Jakarta"),
        ("Cikarang Barat", "West Java"): ("Cikarang Barat", "Jawa Barat"),
    }
    got = evaluate(places.resolve_place("v", "w"), list(cases), "v string, w string")
    assert [(g.city, g.province) for g in got] == list(cases.values())


@pytest.mark.parametrize("value, low, high", [
    ("Rp 7\xa0jt-9\xa0jt", 7_000_000, 9_000_000), ("Rp 6,8 jt-7,4 jt", 6_800_000, 7_400_000),
    ("Rp 2.5 jt", 2_500_000, 2_500_000), ("IDR 5.000.000 - 7.000.000", 5_000_000, 7_000_000),
    ("Rp 1.500.000", 1_500_000, 1_500_000), ("Rp 5 - 7 juta", 5_000_000, 7_000_000),
    ("Rp 500 rb - 750 rb", 500_000, 750_000),
])
def test_pay_amounts(evaluate, value, low, high):
    [pay] = evaluate(salary.parse_salary("v", "IDR", "MONTH"), [value])
    assert (pay.status, pay.minimum, pay.maximum, pay.currency) == ("DISCLOSED", low, high, "IDR")
    assert ("SALARY_SINGLE_VALUE" in pay.flags) == (low == high)


def test_pay_statuses(evaluate):
    hidden = ["Gaji Tidak Ditampilkan", "Gaji di atas ekspektasi", "", None, "  ", "Not Specified"]
    monthly = salary.parse_salary("v", "IDR", "MONTH")
    for pay in evaluate(monthly, hidden):
        assert (pay.status, pay.minimum, pay.monthly_minimum) == ("NOT_DISCLOSED", None, None)
    statuses = evaluate(monthly, ["Gaji nego", "Sesuai standar perusahaan", "Rp 0", "Rp 9 jt - 7 jt"])
    assert [p.status for p in statuses] == ["NEGOTIABLE", "UNPARSEABLE", "INVALID", "INVALID"]
    assert statuses[3].flags == ["SALARY_MIN_GREATER_THAN_MAX"]
    yearly, wide, low = evaluate(monthly, ["Rp 120 juta - 180 juta / tahun", "Rp 12 jt-140 jt", "Rp 300 rb"])
    assert (yearly.period, yearly.period_assumed, yearly.monthly_minimum, yearly.monthly_maximum) == (
        "YEAR", False, 10_000_000, 15_000_000)
    assert {"SALARY_WIDE_RANGE", "SALARY_HIGH_OUTLIER"} <= set(wide.flags) and wide.period_assumed
    assert "SALARY_LOW_OUTLIER" in low.flags
    bare = salary.parse_salary("v")
    unknown, hourly, usd = evaluate(bare, ["Rp 7 jt-9 jt", "Rp 50 rb / jam", "USD 1,000 - 2,000 per month"])
    assert (unknown.period, unknown.monthly_minimum) == ("UNKNOWN", None)
    assert (hourly.period, hourly.monthly_maximum) == ("HOUR", None)
    assert (usd.currency, usd.minimum, usd.maximum, usd.period, usd.flags) == ("USD", 1000, 2000, "MONTH", [])
    [assumed] = evaluate(salary.parse_salary("v", "IDR"), ["5 jt - 6 jt"])
    assert assumed.flags == ["SALARY_CURRENCY_ASSUMED"]


def test_structured_amounts(evaluate):
    pay = salary.evaluate_amounts(F.col("a"), F.col("b"), F.lit("IDR"), F.lit("MONTH"))
    one, none = evaluate(pay, [(None, 25_000_000), (None, None)], "a bigint, b bigint")
    assert (one.minimum, one.maximum, one.flags) == (25_000_000, 25_000_000, ["SALARY_SINGLE_VALUE"])
    assert none.status == "NOT_DISCLOSED"


def test_employment_experience_education_age(evaluate):
    kinds = {"Penuh Waktu": "FULL_TIME", "Full-time": "FULL_TIME", "Paruh Waktu": "PART_TIME",
             "Kontrak": "CONTRACT", "Internship": "INTERNSHIP", "Freelance": "FREELANCE", None: "UNKNOWN",
             "Lainnya": "UNKNOWN"}
    assert evaluate(attributes.employment_type("v"), list(kinds)) == list(kinds.values())
    years = {"1–3 tahun": (1, 3, "Y1_3"), "5–10 tahun": (5, 10, "Y5_10"),
             "Lebih dari 10 tahun": (10, None, "OVER_10"), "Kurang dari 1 tahun": (0, 1, "UNDER_1"),
             "Fresh Graduate": (0, 0, "UNDER_1"), "2+ years": (2, None, "Y1_3"),
             "Not Specified": (None, None, "UNKNOWN")}
    assert [tuple(e) for e in evaluate(attributes.parse_experience("v"), list(years))] == list(years.values())
    schools = {"Minimal Sarjana (S1)": "BACHELOR", "Minimal Diploma (D1 - D4)": "DIPLOMA",
               "Minimal SMA/SMK": "SMA_SMK", "Minimal SD": "SD", "Minimal Magister (S2)": "MASTER",
               "Minimal Pendidikan Profesi": "PROFESSIONAL", "Tidak ada": "UNKNOWN"}
    assert evaluate(attributes.education_level("v"), list(schools)) == list(schools.values())
    ages = {"Kemarin": (1, False, False), "UrgentKemarin": (1, True, False),
            "Urgent3 hari yang lalu": (3, True, False), "13 jam yang lalu": (0, False, False),
            "2 bulan yang lalu": (60, False, True), "Not Specified": (None, False, False),
            "tanggal tidak jelas": (None, False, False)}
    assert [tuple(a) for a in evaluate(attributes.parse_posting_age("v"), list(ages))] == list(ages.values())


def test_card_tags(evaluate):
    tags = [["Hybrid", "+3", "SQL", "Python", "SQL"], ["+5", "Remote/Dari rumah"],
            ["Perusahaan Premium", "Excel"], None]
    a, b, c, d = evaluate(attributes.split_card_tags("v"), [(t,) for t in tags], "v array<string>")
    assert (a.skills, a.hidden_count, a.work_arrangement) == (["SQL", "Python"], 3, "HYBRID")
    assert (b.skills, b.work_arrangement, b.evidence) == ([], "REMOTE", "Remote/Dari rumah")
    assert (c.skills, c.ignored) == (["Excel"], ["Perusahaan Premium"])
    assert (d.skills, d.hidden_count, d.work_arrangement) == ([], 0, "UNKNOWN")


def test_role_families(evaluate):
    cases = {
        "Data Engineer": "DATA_ANALYTICS", "QA Engineer": "QUALITY_ASSURANCE",
        "DevOps Engineer": "INFRASTRUCTURE_DEVOPS", "C++ Software Engineer": "SOFTWARE_ENGINEERING",
        "UI/UX Designer Intern": "DESIGN_CREATIVE", "IT Project Manager": "PRODUCT_PROJECT",
        "Administrator HR": "HUMAN_RESOURCES", "Finance, Accounting & Tax": "FINANCE_ACCOUNTING",
        "Management Trainee": "GRADUATE_PROGRAM", "Cook Helper": "FOOD_HOSPITALITY",
        "Store Crew (SMA/Sederajat)": "RETAIL_STORE", "Kurir Motor Ekspedisi Bekasi": "TRANSPORT_DELIVERY",
        "Operator Produksi": "PRODUCTION", "Production Engineer": "ENGINEERING", "Satpam": "SECURITY_FACILITIES",
        "Admin Gudang": "SUPPLY_CHAIN", "Master of Ceremony": "OTHER", "": "OTHER", None: "OTHER",
    }
    assert evaluate(classify.role_family("v"), list(cases)) == list(cases.values())


def test_skills(evaluate):
    cases = {
        "Pengalaman JavaScript dan React Native, bukan Java": ["Java", "JavaScript", "React Native"],
        "Javascript developer": ["JavaScript"], "Mampu go ke lapangan, R&D, mengetik di Word": [],
        "C++ dan C# serta .NET": ["C#", "C++", ".NET"], None: [],
        "mengelola jaringan komunikasi kantor": [], "spreadsheet akan jadi teman terbaikmu": [],
        "Minimal S1 di bidang Bahasa Inggris, Komunikasi": [],
        "Pendidikan D3 Akuntansi. Menguasai Excel": ["Microsoft Excel"],
        "Pendidikan S1. Mampu berbahasa Inggris (English) aktif": ["English"],
    }
    assert evaluate(classify.extract_skills("v"), list(cases)) == list(cases.values())


def test_titles(evaluate):
    rows = [
        ("Karir Tanpa Syarat Rumit Operasional Kereta Api PT KAI Pasuruan tahun 2025",
         "PT KERETA API INDONESIA (PERSERO)", "Pasuruan"),
        ("Peluang Kerja Operasional Kereta Api PT KAI Wonosobo tahun 2025",
         "PT KERETA API INDONESIA (PERSERO)", "Wonosobo"),
        ("Lowongan C++ Developer Bandung", "PT Contoh", "Bandung"),
        ("x net#loker dev", None, None),
    ]
    key = titles.title_key("v", "o", "p")
    schema = "v string, o string, p string"
    assert evaluate(key, rows, schema) == ["operasional kai", "operasional kai", "c++ developer", "x net# dev"]
    shown = titles.display_title("v", "o")
    rows = [("Lowongan Kerja Admin Gudang PT Maju (Lamar Sekarang) - Bisa Kerja", "PT Maju", None),
            ("Kasir PT Maju, PT Maju", "PT Maju", None), ("loker ab", None, None), (None, None, None)]
    assert evaluate(shown, rows, schema) == ["Admin Gudang PT Maju", "Kasir PT Maju", "loker ab", None]
    assert evaluate(titles.organization_key("v"), ["PT. Maju Jaya, Tbk", "JAC Recruitment Indonesia", None]) == [
        "maju jaya", "jac recruitment", ""]


def test_urls(evaluate):
    assert evaluate(urls.canonical_page_url("v"), ["HTTPS://LokerContoh.id/Admin-Gudang/?a=1#top", "https://a.id"]) == [
        "https://lokercontoh.id/Admin-Gudang?a=1", "https://a.id/"]
    assert evaluate(urls.publisher_site("v"), ["https://u:p@WWW.Site.id:8080/x", "nothing", None]) == ["site.id", None, None]
    cases = {"https://jobs.example.co/acme/123": True, "http://example.co.id/karir?id=1": True,
             "javascript:alert(1)": False, "ftp://example.com/job": False, "/relative/path": False, "https://": False}
    assert [v is not None for v in evaluate(urls.validated_url("v"), list(cases))] == list(cases.values())
    assert evaluate(urls.site_type("v"), ["lokerbandung.id", "rsuhermina.co.id", None]) == ["job_site", "other", "other"]


def test_jsonld(evaluate):
    page = """<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},
      {"@type":"JobPosting","title":"A"}]}</script>
    <script type='application/ld+json'>[{"@type":["JobPosting"],"title":"B\twith tab"}]</script>
    <script type="application/ld+json">{"@type": "JobPosting", broken}</script>
    <script type="application/ld+json">{"@type":"Organization"}</script>"""
    found, empty = evaluate(jsonld.extract_job_postings("v"), [page, "<p>none</p>"])
    assert [p.count('"title"') for p in found.postings] == [1, 1] and found.malformed == 1
    assert '"B\\twith tab"' in found.postings[1] and empty.postings == []


def test_every_named_entity_is_decoded(evaluate):
    texts = [f"a&{name}b" for name in entities.html5 if name.endswith(";")]
    texts += ["&check; &plus; &num; &lpar;x&rpar;", "&amp;check; &check;", "&AMP;lt; &amp;AMP;", "&nope; &amp", "x & y"]
    assert evaluate(text.unescape_html("v"), texts) == [html.unescape(t) for t in texts]


def test_plain_texts_skip_steps_and_others_do_not(evaluate):
    given = ["a b", " a  b ", "a\tb", "a\x1cb", "a b", "\n", "a&AMP;b", "a&amp;b &Tab;c", "Café", "ﬁn", "N/A", "", None]
    out = evaluate(text.clean_text(text.unescape_html("v")), given)
    assert out == ["a b", "a b", "a b", "a b", "a b", None, "a&b", "a&b c", "Café", "fin", None, None, None]
    assert evaluate(text.fold_accents("v"), ["ABC", "CafÉ", "ẞ", "ﬁ", None]) == ["abc", "cafe", "ss", "fi", ""]
