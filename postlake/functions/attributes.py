"""Employment type, experience, education, card tags and posting age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import (
    any_phrase, as_column, clean_text, fold_accents, let, literal_map, lookup, nfkc,
    normalize_for_matching, squeeze, tidy,
)
from postlake.rules.words import (
    AGE_UNIT_DAYS, APPROXIMATE_AGE_UNITS, BADGE_TAGS, EDUCATION_PHRASES, EMPLOYMENT_CODES,
    EMPLOYMENT_PHRASES, EXPERIENCE_LEAST, EXPERIENCE_LESS, EXPERIENCE_RANGE, EXPERIENCE_SINGLE,
    NO_EXPERIENCE_PHRASES, TAG_ARRANGEMENTS,
)


def _ordered(rules, default: str) -> Column:
    """First true condition of (condition, code) pairs."""
    rules = list(rules)
    chain = F.when(rules[0][0], rules[0][1])
    for condition, code in rules[1:]:
        chain = chain.when(condition, code)
    return chain.otherwise(default)


def employment_type(value: Column | str) -> Column:
    return let(
        normalize_for_matching(clean_text(value)),
        lambda key: _ordered(((key.contains(p), code) for p, code in EMPLOYMENT_PHRASES), "UNKNOWN"),
    )


def employment_code(value: Column | str) -> Column:
    """schema.org employment codes."""
    key = F.replace(F.upper(as_column(value)), F.lit("-"), F.lit("_"))
    return F.coalesce(lookup(EMPLOYMENT_CODES, key), F.lit("UNKNOWN"))


def experience_band(low: Column, high: Column) -> Column:
    """Bucket by the lower bound, which is what a job seeker must satisfy."""
    return (
        F.when(low.isNull(), F.when(high <= 1, "UNDER_1").otherwise("UNKNOWN"))
        .when(low < 1, "UNDER_1").when(low < 3, "Y1_3").when(low < 5, "Y3_5")
        .when(low < 10, "Y5_10").otherwise("OVER_10")
    )


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def parse_experience(value: Column | str, cleaned: bool = False) -> Column:
    """struct(min_years, max_years, band)."""
    return let(F.lower(as_column(value) if cleaned else clean_text(value)), _experience)


def _experience(text: Column) -> Column:
    seen = F.struct(
        any_phrase(text, NO_EXPERIENCE_PHRASES).alias("fresh"),
        _number(text, EXPERIENCE_RANGE, 1).alias("a"),
        _number(text, EXPERIENCE_RANGE, 2).alias("b"),
        _number(text, EXPERIENCE_LESS, 1).alias("less"),
        F.coalesce(_number(text, EXPERIENCE_LEAST, 1), _number(text, EXPERIENCE_LEAST, 2)).alias("least"),
        _number(text, EXPERIENCE_SINGLE, 1).alias("single"),
    )

    def bounds(s: Column) -> Column:
        ranged, below, above = s["a"].isNotNull(), s["less"].isNotNull(), s["least"].isNotNull()
        low = (
            F.when(s["fresh"], 0).when(ranged, F.least(s["a"], s["b"])).when(below, 0)
            .when(above, s["least"]).otherwise(s["single"])
        )
        high = (
            F.when(s["fresh"], 0).when(ranged, F.greatest(s["a"], s["b"])).when(below, s["less"])
            .when(above, None).otherwise(s["single"])
        )
        return F.struct(low.alias("low"), high.alias("high"))

    return let(
        let(seen, bounds),
        lambda b: F.struct(
            b["low"].alias("min_years"), b["high"].alias("max_years"),
            experience_band(b["low"], b["high"]).alias("band"),
        ),
    )


def education_level(value: Column | str, cleaned: bool = False) -> Column:
    """Ordered key phrases; codes of up to three letters must be whole words."""
    key = normalize_for_matching(as_column(value) if cleaned else clean_text(value))
    return let(key, _education)


def _education(key: Column) -> Column:
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    return _ordered(
        (
            (key.contains(p) if len(p) > 3 else padded.contains(f" {p} "), code)
            for p, code in EDUCATION_PHRASES
        ),
        "UNKNOWN",
    )


def split_card_tags(tags: Column | str) -> Column:
    """struct(skills, hidden_count, work_arrangement, evidence, ignored) of an array of tags.

    The array is cleaned and folded as one joined string, so Unicode rows cross to Python
    once per row and everything after that is array expressions.
    """
    mark = "\u0001"
    text = clean_join(tags, mark)
    return let(
        F.arrays_zip(F.split(text, mark).alias("tag"), F.split(fold_accents(text), mark).alias("key")),
        _sorted_tags,
    )


def _sorted_tags(pairs: Column) -> Column:
    arrangement = literal_map(TAG_ARRANGEMENTS)
    kinds = F.transform(
        F.filter(
            F.transform(
                pairs, lambda p: F.struct(tidy(p["tag"]).alias("tag"), squeeze(p["key"]).alias("key"))
            ),
            lambda p: p["tag"].isNotNull(),
        ),
        lambda p: F.struct(
            p["tag"].alias("tag"),
            F.when(p["tag"].rlike(r"^\+\d+$"), "hidden")
            .otherwise(F.coalesce(F.try_element_at(arrangement, p["key"]),
                                  F.when(p["key"].isin(*BADGE_TAGS), "badge"), F.lit("skill")))
            .alias("kind"),
        ),
    )
    return let(kinds, _card)


def _card(kinds: Column) -> Column:
    def of(*names: str) -> Column:
        return F.transform(F.filter(kinds, lambda p: p["kind"].isin(*names)), lambda p: p["tag"])

    modes = F.filter(kinds, lambda p: ~p["kind"].isin("hidden", "badge", "skill"))
    last = F.try_element_at(modes, F.lit(-1))
    return F.struct(
        F.array_distinct(of("skill")).alias("skills"),
        F.aggregate(
            of("hidden"), F.lit(0), lambda acc, t: acc + F.substring(t, 2, 10).try_cast("int")
        ).alias("hidden_count"),
        F.coalesce(last["kind"], F.lit("UNKNOWN")).alias("work_arrangement"),
        last["tag"].alias("evidence"),
        of("badge").alias("ignored"),
    )


def clean_join(tags: Column | str, mark: str) -> Column:
    tags = F.coalesce(as_column(tags), F.array().cast("array<string>"))
    return nfkc(F.array_join(F.filter(tags, lambda t: t.isNotNull()), mark))


def parse_posting_age(value: Column | str, cleaned: bool = False) -> Column:
    """struct(days, is_urgent, approximate) of a relative age such as '3 hari yang lalu'."""
    return let(F.lower(as_column(value) if cleaned else clean_text(value)), _age)


def _age(text: Column) -> Column:
    pattern = r"(\d+)\s*(menit|jam|hari|minggu|bulan|tahun)"
    urgent = F.coalesce(text.startswith("urgent"), F.lit(False))
    seen = F.struct(
        urgent.alias("urgent"),
        F.when(urgent, F.trim(F.substring(text, 7, 1_000_000))).otherwise(text).alias("rest"),
        F.regexp_extract(text, pattern, 2).alias("unit"),
        _number(text, pattern, 1).alias("count"),
    )

    def aged(s: Column) -> Column:
        today, yesterday = s["rest"].isin("baru saja", "hari ini"), s["rest"] == "kemarin"
        return F.struct(
            F.when(today, 0).when(yesterday, 1).otherwise(s["count"] * lookup(AGE_UNIT_DAYS, s["unit"]))
            .alias("days"),
            s["urgent"].alias("is_urgent"),
            F.coalesce(~today & ~yesterday & s["unit"].isin(*APPROXIMATE_AGE_UNITS), F.lit(False))
            .alias("approximate"),
        )

    return let(seen, aged)
