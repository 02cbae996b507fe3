"""Provinces and cities from free-text locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import (
    any_phrase, as_column, clean_text, fold_accents, let, literal_map, squeeze,
)
from postlake.rules.places import (
    COUNTRY_WORDS, NATIONWIDE_WORDS, PROVINCE_OF_CITY, PROVINCE_OF_SPELLING, REMOTE_WORDS,
)
from postlake.rules.words import MISSING_MARKERS

_REGENCY = r"(?i)^(?:kab\.?|kabupaten)\s+"
_TOWN = r"(?i)^(?:kota(?:\s+administrasi)?)\s+"


def _province_of_folded(folded: Column) -> Column:
    """Province named by folded text (works inside array lambdas: no Python step)."""
    key = squeeze(F.regexp_replace(folded, r"^provinsi\s+", ""))
    return F.try_element_at(literal_map(PROVINCE_OF_SPELLING), key)


def canonical_province(value: Column | str) -> Column:
    return _province_of_folded(fold_accents(value))


def _one_spelling(city: Column) -> Column:
    return F.regexp_replace(city, _REGENCY, "Kabupaten ")


def canonical_city(value: Column | str) -> Column:
    """One spelling per regency; 'Kota' and unprefixed names stay as written."""
    return _one_spelling(clean_text(value))


def _city_province(folded: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(folded, _REGENCY, ""), _TOWN, "")
    return F.try_element_at(literal_map(PROVINCE_OF_CITY), squeeze(bare))


def _regency_marker(city: Column) -> Column:
    return F.when(city.rlike(_REGENCY), True).when(city.rlike(_TOWN), False)


def parse_location(value: Column | str, cleaned: bool = False) -> Column:
    """struct(city, province, confidence, is_remote, is_regency) of a location text."""
    text = as_column(value) if cleaned else clean_text(value)
    return let(F.struct(text.alias("text"), fold_accents(text).alias("folded")), _located)


def _located(v: Column) -> Column:
    last_comma = r"(?s)^(.*),([^,]*)$"
    seen = F.struct(
        v["text"].alias("text"),
        any_phrase(F.lower(v["text"]), REMOTE_WORDS).alias("remote"),
        F.trim(F.regexp_extract(v["text"], last_comma, 1)).alias("head"),
        squeeze(F.regexp_extract(v["folded"], last_comma, 1)).alias("head_key"),
        F.when(
            v["text"].contains(","),
            _province_of_folded(F.trim(F.regexp_extract(v["folded"], last_comma, 2))),
        ).alias("listed"),
        _province_of_folded(v["folded"]).alias("alone"),
        _city_province(v["folded"]).alias("inferred"),
    )

    def placed(s: Column) -> Column:
        listed, alone = s["listed"].isNotNull(), s["alone"].isNotNull()
        # A head that only repeats the province is no city.
        is_city = (s["head_key"] != squeeze(F.lower(s["listed"]))) & _informative(s["head"])
        free = ~listed & ~alone & ~s["remote"]
        city = F.when(listed & is_city, s["head"]).when(free, s["text"])
        return F.struct(
            _one_spelling(city).alias("city"),
            F.coalesce(s["listed"], s["alone"], F.when(free, s["inferred"])).alias("province"),
            F.when(listed | alone, "SOURCE_STRUCTURED")
            .when(free & s["inferred"].isNotNull(), "INFERRED").otherwise("UNKNOWN").alias("confidence"),
            F.coalesce(s["remote"], F.lit(False)).alias("is_remote"),
            _regency_marker(_one_spelling(city)).alias("is_regency"),
        )

    return let(seen, placed)


def _informative(text: Column) -> Column:
    return ~F.lower(text).isin(*MISSING_MARKERS)


def resolve_place(locality: Column | str, region: Column | str) -> Column:
    """struct(city, province) of two address parts that are already clean text."""
    locality, region = as_column(locality), as_column(region)
    return resolve_folded_place(locality, region, fold_accents(locality), fold_accents(region))


def resolve_folded_place(
    locality: Column, region: Column, locality_folded: Column, region_folded: Column
) -> Column:
    """As ``resolve_place`` with the folded forms given, so it can run inside array lambdas.

    Any part naming a province is the province, never the city. The city is the first other
    part; when no province is named it is inferred from a known city.
    """
    skip = COUNTRY_WORDS + NATIONWIDE_WORDS
    # Folding keeps the commas, so part i of the folded text belongs to part i of the text.
    written = F.split(F.concat_ws(",", region, locality), ",")
    folded = F.split(F.concat_ws(",", _blank(region, region_folded), _blank(locality, locality_folded)), ",")
    parts = F.zip_with(
        written, folded,
        lambda w, f: F.struct(F.trim(w).alias("text"), F.trim(f).alias("folded")),
    )
    parts = F.filter(parts, lambda p: (p["text"] != "") & ~F.lower(p["text"]).isin(*skip))
    named = F.transform(
        parts,
        lambda p: F.struct(
            p["text"].alias("text"), p["folded"].alias("folded"),
            _province_of_folded(p["folded"]).alias("province"),
        ),
    )
    found = F.struct(
        F.get(F.filter(named, lambda p: p["province"].isNotNull()), 0)["province"].alias("province"),
        F.get(F.filter(named, lambda p: p["province"].isNull()), 0).alias("first"),
    )

    def resolved(f: Column) -> Column:
        first = f["first"]
        city = F.when(_informative(first["text"]), _one_spelling(first["text"]))
        inferred = F.when(
            city.isNotNull() & ~any_phrase(first["folded"], REMOTE_WORDS), _city_province(first["folded"])
        )
        return F.struct(city.alias("city"), F.coalesce(f["province"], inferred).alias("province"))

    return let(found, resolved)


def _blank(text: Column, folded: Column) -> Column:
    return F.when(text.isNotNull(), folded)
