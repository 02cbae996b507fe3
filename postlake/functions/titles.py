"""Title and employer keys, display titles, employer rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import as_column, let, normalize_for_matching
from postlake.rules.words import (
    CONFIDENTIAL_EMPLOYERS, CONFIDENTIAL_NAME, EMPLOYER_NOISE, HOUSEHOLD_EMPLOYERS,
    HOUSEHOLD_NAME, LEGAL_FORMS, PLACEHOLDER_EMPLOYERS, SITE_NAME_WORDS, TITLE_NOISE,
    TITLE_PREFIX, TITLE_SUFFIXES,
)

_GLUE = "\u0001"


def title_key(title: Column | str, organization: Column | str, *places: Column | str) -> Column:
    """Folded title without the employer's words, the posting's place words and boilerplate.

    Words are compared as tokens. '+' and '#' end a word but stay attached to it, so they
    become separate tokens carrying a glue mark while words are dropped.
    """
    names = F.concat_ws(" ", *[as_column(n) for n in (organization, *places)])
    return let(
        F.struct(normalize_for_matching(title).alias("key"), normalize_for_matching(names).alias("names")),
        _kept_words,
    )


def _kept_words(v: Column) -> Column:
    own = F.filter(F.split(v["names"], " "), lambda t: (F.length(t) > 2) & ~t.isin(*LEGAL_FORMS))
    marked = F.regexp_replace(v["key"], "([+#]+)", f" {_GLUE}$1{_GLUE} ")

    def without(own: Column) -> Column:
        kept = F.transform(
            F.split(marked, " "),
            lambda t: F.when(
                F.array_contains(own, t) | t.isin(*TITLE_NOISE, *LEGAL_FORMS) | t.rlike("^20[0-9]{2}$"),
                "",
            ).otherwise(t),
        )
        unglued = F.regexp_replace(F.array_join(kept, " "), f" ?{_GLUE} ?", "")
        return F.trim(F.regexp_replace(unglued, " +", " "))

    return let(own, without)


def organization_key(organization: Column | str) -> Column:
    key = normalize_for_matching(organization)
    return F.trim(F.regexp_replace(F.regexp_replace(key, EMPLOYER_NOISE, " "), " +", " "))


def display_title(title: Column | str, organization: Column | str) -> Column:
    """The title without site boilerplate and without a repeated employer name; casing kept."""
    title = F.trim(as_column(title))
    text = title
    for pattern in TITLE_SUFFIXES:
        text = F.trim(F.regexp_replace(text, f"(?iU){pattern}", ""))
    text = F.trim(F.regexp_replace(text, f"(?iU){TITLE_PREFIX}", ""))
    text = F.regexp_replace(text, r"^20\d\d\s+(?:di\s+)?", "")
    seen = F.struct(
        title.alias("title"), text.alias("text"), F.lower(text).alias("lowered"),
        F.lower(as_column(organization)).alias("name"), F.length(as_column(organization)).alias("size"),
    )
    return let(let(seen, _once_named), _presented)


def _once_named(s: Column) -> Column:
    """Cut the last mention of an employer that is named more than once."""
    size, lowered = s["size"], s["lowered"]
    mentions = F.length(lowered) - F.length(F.replace(lowered, s["name"], F.lit("")))
    cut = F.length(lowered) - F.position(F.reverse(s["name"]), F.reverse(lowered)) - size + 1
    rest = F.concat(F.substr(s["text"], F.lit(1), cut), F.substr(s["text"], cut + size + 1))
    text = F.when((size > 0) & (mentions > size), F.regexp_replace(rest, r"^[ ,]+|[ ,]+$", "")).otherwise(s["text"])
    spaced = F.regexp_replace(F.regexp_replace(text, r"(?U)\s{2,}", " "), r"(?U)\s+,", ",")
    return F.struct(s["title"].alias("title"), spaced.alias("text"))


def _presented(s: Column) -> Column:
    text = s["text"]
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))
    return F.when(F.length(text) < 3, s["title"]).otherwise(capital)


def neutral_employer(organization: Column | str) -> Column:
    """struct(name, flag): withheld and household employers get one neutral name."""
    organization = as_column(organization)

    def named(v: Column) -> Column:
        withheld, household = v["key"].isin(*CONFIDENTIAL_EMPLOYERS), v["key"].isin(*HOUSEHOLD_EMPLOYERS)
        return F.struct(
            F.when(withheld, CONFIDENTIAL_NAME).when(household, HOUSEHOLD_NAME).otherwise(v["name"])
            .alias("name"),
            F.when(withheld, "EMPLOYER_CONFIDENTIAL").when(household, "EMPLOYER_HOUSEHOLD").alias("flag"),
        )

    return let(
        F.struct(organization.alias("name"), normalize_for_matching(organization).alias("key")), named
    )


def is_placeholder_employer(organization: Column | str, domain: Column | str) -> Column:
    """A generic word, or the site's own name with at most job-board words added."""
    label = F.split_part(as_column(domain), F.lit("."), F.lit(1))
    seen = F.struct(
        normalize_for_matching(organization).alias("name"),
        F.replace(normalize_for_matching(label), F.lit(" "), F.lit("")).alias("site"),
    )

    def judged(v: Column) -> Column:
        packed = F.replace(v["name"], F.lit(" "), F.lit(""))
        bare = F.replace(F.regexp_replace(v["name"], SITE_NAME_WORDS, " "), F.lit(" "), F.lit(""))
        bare_site = F.regexp_replace(v["site"], SITE_NAME_WORDS, "")
        return (
            v["name"].isin(*PLACEHOLDER_EMPLOYERS) | (packed == v["site"])
            | ((bare != "") & (bare == bare_site))
        )

    return let(seen, judged)
