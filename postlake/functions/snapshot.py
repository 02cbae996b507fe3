"""Cleaning and feature columns of the original snapshot profile.

Kept for comparison only: hidden pay is the number zero here, which the job columns in
``jobs.py`` never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import any_phrase, as_column

# Fixed values of the profile.
NOT_SPECIFIED = "Not Specified"
HIDDEN = "Tidak Ditampilkan"
ELSEWHERE = "Luar Daerah / Lainnya"
HIDDEN_PAY = (
    "tidak menampilkan gaji", "gaji di atas ekspektasi", "not specified", "tidak ditampilkan",
)
PROVINCE_HINTS = (
    ("DKI Jakarta", ("jakarta", "dki")),
    ("Jawa Barat", ("jawa barat", "bandung", "bekasi", "depok", "bogor", "karawang", "purwakarta")),
    ("Jawa Tengah", ("jawa tengah", "semarang", "surakarta", "solo", "cilacap", "sukoharjo")),
    ("Jawa Timur", ("jawa timur", "surabaya", "malang", "sidoarjo", "mojokerto")),
    ("Banten", ("banten", "tangerang")),
    ("Sumatera Utara", ("sumatera utara", "medan")),
)


def filled(value: Column | str) -> Column:
    return F.coalesce(F.trim(as_column(value).cast("string")), F.lit(NOT_SPECIFIED))


def standard_location(value: Column | str) -> Column:
    text = filled(value)
    return F.when(
        any_phrase(F.lower(text), ("not specified", "lihat perusahaan")), NOT_SPECIFIED
    ).otherwise(text)


def standard_salary(value: Column | str) -> Column:
    text = F.coalesce(F.trim(as_column(value).cast("string")), F.lit(HIDDEN))
    return F.when(any_phrase(F.lower(text), HIDDEN_PAY), HIDDEN).otherwise(text)


def city_of(location: Column | str) -> Column:
    location = as_column(location)
    return F.when(
        location.contains(","), F.trim(F.split_part(location, F.lit(","), F.lit(1)))
    ).otherwise(location)


def province_of(location: Column | str) -> Column:
    location = as_column(location)
    last = F.trim(F.split_part(location, F.lit(","), F.lit(-1)))
    lowered = F.lower(location)
    hints = F.coalesce(
        *[F.when(any_phrase(lowered, words), name) for name, words in PROVINCE_HINTS], F.lit(ELSEWHERE)
    )
    listed = F.when(any_phrase(F.lower(last), ("dki", "jakarta")), "DKI Jakarta").otherwise(last)
    return (
        F.when(location == NOT_SPECIFIED, NOT_SPECIFIED)
        .when(location.contains(","), listed).otherwise(hints)
    )


def pay_bound(text: Column | str, which: int) -> Column:
    """Lower (0) or upper (1) bound; one number serves as both; hidden pay is 0."""
    text = F.lower(as_column(text))
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    decimals = F.regexp_extract_all(plain, F.lit(r"\d+\.?\d*"), F.lit(0))
    whole = F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0))

    def pick(numbers: Column) -> Column:
        return F.coalesce(F.get(numbers, which), F.get(numbers, 0))

    millions = F.floor(pick(decimals).try_cast("double") * 1_000_000).cast("bigint")
    scaled = any_phrase(plain, ("jt", "juta")) & (F.size(decimals) > 0)
    return F.when(text.contains("tidak ditampilkan"), 0).otherwise(
        F.coalesce(F.when(scaled, millions), pick(whole).try_cast("bigint"), F.lit(0))
    )


def clean_snapshot(df: DataFrame) -> DataFrame:
    """One row per (title, company, location), chosen by a full ordering, texts filled."""
    keys = ["job_title", "company_name", "location"]
    rest = [n for n in df.columns if n not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return one.select(*df.columns).withColumns(
        {n: filled(n) for n in df.columns if n not in ("location", "salary_range")}
        | {"location": standard_location("location"), "salary_range": standard_salary("salary_range")}
    )


def snapshot_features(df: DataFrame) -> DataFrame:
    hidden = F.lower("salary_range").contains("tidak ditampilkan")
    wanted = F.lower("job_requirements") == "not specified"
    return df.withColumns(
        {
            "city": city_of("location"),
            "province": province_of("location"),
            "salary_visible": F.when(hidden, 0).otherwise(1),
            "salary_min": pay_bound("salary_range", 0),
            "salary_max": pay_bound("salary_range", 1),
            "title_length": F.length("job_title"),
            "requirements_length": F.when(wanted, 0).otherwise(F.length("job_requirements")),
        }
    )
