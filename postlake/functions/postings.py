"""One schema.org JobPosting (JSON text) to one flat observation row.

``normalize_postings`` is a plain ``DataFrame -> DataFrame`` job: JSON is opened once into a
struct of VARIANT fields, the polymorphic fields (string, object or list in the same place)
are coerced by expressions, and every rule is a column.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.attributes import education_level, employment_code
from postlake.functions.classify import extract_skills, role_family
from postlake.functions.places import resolve_folded_place
from postlake.functions.salary import evaluate_amounts
from postlake.functions.text import (
    clean_text, description_text, fold_accents, let, lookup, nfkc, repair_mojibake,
    tidy, unescape_html,
)
from postlake.functions.titles import (
    display_title, is_placeholder_employer, neutral_employer, organization_key, title_key,
)
from postlake.functions.urls import canonical_page_url, site_type
from postlake.rules import limits
from postlake.rules.places import COUNTRY_WORDS
from postlake.rules.words import (
    CREDENTIALS, CURRENCY_ALIASES, NOT_A_VACANCY, PARSER_VERSION, PAY_UNITS,
)

FIELDS = (
    "title", "name", "hiringOrganization", "description", "jobLocation", "baseSalary",
    "employmentType", "datePosted", "validThrough", "identifier", "jobLocationType",
    "experienceRequirements", "educationRequirements",
)
_MARK, _PLACE_MARK = "\u0001", "\u0002"  # between address parts, between places


# --- coercion of polymorphic JSON -----------------------------------------------------------


# These are SQL text rather than nested Column calls: one parsed expression per field keeps
# plan building short.

_names = count()


def _bind(value: str, body) -> str:
    """``body`` over ``value`` bound once to a fresh lambda variable."""
    name = f"v{next(_names)}"
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, i{name}) -> {name}, {name} -> {body(name)})"


def _sub(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def _is(value: str, kind: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), '{kind}'), false)"


def _truthy(value: str) -> str:
    """The value unless it is null, '', 0, false, {} or []."""
    empty = """('""', '0', 'false', '{}', '[]')"""
    return _bind(value, lambda v: f"case when not coalesce(is_variant_null({v}) or to_json({v}) in {empty}, true) then {v} end")


def _named(value: str) -> str:
    """An object stands for its name, value or @value, whichever is filled first."""
    fields = ("$.name", "$.value", '$["@value"]')
    return _bind(
        value,
        lambda v: f"case when {_is(v, 'OBJECT')} then coalesce({', '.join(_truthy(_sub(v, f)) for f in fields)}) else {v} end",
    )


def _items(value: str) -> str:
    """The items of a list, or the value itself as the only item."""
    return _bind(
        value,
        lambda v: f"case when {_is(v, 'ARRAY')} then try_variant_get({v}, '$', 'array<variant>') else array({v}) end",
    )


def _first_item(value: str) -> str:
    """For a list, its first string or object; other values stay as they are."""
    x = f"x{next(_names)}"
    return _bind(
        value,
        lambda v: f"case when {_is(v, 'ARRAY')} then get(filter(try_variant_get({v}, '$', 'array<variant>'), "
        f"{x} -> {_is(x, 'OBJECT')} or {_is(x, 'STRING')}), 0) else {v} end",
    )


def _scalar(value: str) -> str:
    """Text of a string or number; NULL for anything else."""
    return _bind(
        value,
        lambda v: f"case when not schema_of_variant({v}) rlike '^(OBJECT|ARRAY|VOID)' then try_variant_get({v}, '$', 'string') end",
    )


def _any_text(value: str) -> str:
    return _scalar(_named(_first_item(_named(value))))


def _raw_text(value: str) -> str:
    """``_any_text``, whose nested steps run only for values that are neither missing, a string nor an object named by one."""

    def told(v: str) -> str:
        name = f"try_variant_get({v}, '$.name', 'string')"
        return (
            f"case when {v} is null then null when schema_of_variant({v}) = 'STRING' then try_variant_get({v}, '$', 'string') "
            f"when schema_of_variant({_sub(v, '$.name')}) = 'STRING' and {name} <> '' then {name} else {_any_text(v)} end"
        )

    return told(value) if value.isidentifier() else _bind(value, told)


def raw_text(value: str) -> Column:
    """Text of a string, number, named object, or a list's first usable item."""
    return F.expr(_raw_text(value))


def identifier_text(value: str) -> Column:
    """A string or integer, or an object's ``value`` (its ``name`` is usually the employer);
    for a list the first item that gives one."""
    v, t = f"x{next(_names)}", f"x{next(_names)}"
    inner = f"coalesce({_filled(_sub(v, '$.value'))}, {_sub(v, '$[\"@value\"]')})"
    one = (
        f"case when {_is(v, 'OBJECT')} then try_variant_get({inner}, '$', 'string') "
        f"when {_is(v, 'STRING')} or {_is(v, 'BIGINT')} then try_variant_get({v}, '$', 'string') end"
    )
    return F.expr(f"get(filter(transform({_items(value)}, {v} -> {one}), {t} -> trim({t}) <> ''), 0)")


def _filled(value: str) -> str:
    return _bind(value, lambda v: f"case when not is_variant_null({v}) then {v} end")


def parse_date(text: Column) -> Column:
    """The calendar date as written: ISO date or date-time, else the first ten characters."""
    compact = F.when(
        text.rlike(r"^\d{8}(T.*)?$"),
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    )
    ten = F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10))
    return F.try_to_date(F.coalesce(compact, ten))


def _amount(value: str) -> Column:
    """Whole amount of a number or numeric text with thousands commas (half to even)."""
    text = F.replace(F.expr(_scalar(value)), F.lit(","), F.lit(""))
    return F.rint(F.trim(text).try_cast("double")).try_cast("bigint")


# --- the job --------------------------------------------------------------------------------


def open_postings(df: DataFrame, json_col: str = "posting") -> DataFrame:
    """Add the JobPosting fields as VARIANT columns prefixed ``p_``."""
    whole = F.try_parse_json(F.col(json_col))
    out = df.withColumn("p", whole)
    return out.withColumns({f"p_{f}": F.expr(_sub("p", f"$.{f}")) for f in FIELDS}).drop("p")


def _tidy_texts(df: DataFrame, raw: dict[str, Column]) -> DataFrame:
    """Entity-decoded, repaired, NFKC, tidied text for several fields at once.

    The staged projections let Spark batch all fields of a stage into one Arrow exchange.
    """
    df = df.withColumns(raw)
    df = df.withColumns({name: unescape_html(name) for name in raw})
    df = df.withColumns({name: repair_mojibake(name) for name in raw})
    df = df.withColumns({name: nfkc(name) for name in raw})
    return df.withColumns({name: tidy(name) for name in raw})


def _address_texts(df: DataFrame) -> DataFrame:
    """``places``: array of address structs, with text repaired for all places in one pass.

    The parts of every place are joined into one marked string, cleaned once per row, and
    split back, because Python steps cannot run inside array lambdas.
    """
    item = f"x{next(_names)}"
    filled = f"{_is(item, 'OBJECT')} and to_json({item}) <> '{{}}'"
    df = df.withColumn("place_items", F.expr(f"filter({_items('p_jobLocation')}, {item} -> {filled})"))
    place = f"x{next(_names)}"
    names = ("streetAddress", "addressLocality", "addressRegion", "addressCountry")

    def joined(address: str) -> str:
        parts = ", ".join(f"coalesce({_raw_text(_sub(address, '$.' + n))}, '')" for n in names)
        return f"array_join(array({parts}), '{_MARK}')"

    inner = _bind(_sub(place, "$.address"), lambda v: f"case when {_is(v, 'OBJECT')} then {v} else {place} end")
    df = df.withColumn("place_parts", F.expr(f"transform(place_items, {place} -> {_bind(inner, joined)})"))
    places = F.col("place_items")
    df = df.withColumn("place_text", F.array_join("place_parts", _PLACE_MARK))
    df = df.withColumn("place_count", F.coalesce(F.size(places), F.lit(0)))
    df = df.withColumn("place_text", unescape_html("place_text"))
    df = df.withColumn("place_text", repair_mojibake("place_text"))
    df = df.withColumn("place_text", nfkc("place_text"))
    df = df.withColumn("place_folded", fold_accents("place_text"))
    both = F.arrays_zip(
        F.split("place_text", _PLACE_MARK).alias("t"), F.split("place_folded", _PLACE_MARK).alias("f")
    )

    def parted(pair: Column) -> Column:
        text, folded = F.split(pair["t"], _MARK), F.split(pair["f"], _MARK)
        names = ("street", "locality", "region", "country")
        return F.struct(
            *[tidy(F.get(text, i)).alias(n) for i, n in enumerate(names)],
            F.trim(F.get(folded, 1)).alias("locality_folded"), F.trim(F.get(folded, 2)).alias("region_folded"),
        )

    def placed(p: Column) -> Column:
        place = resolve_folded_place(p["locality"], p["region"], p["locality_folded"], p["region_folded"])
        return let(
            place,
            lambda r: F.struct(
                p["street"].alias("street"), p["locality"].alias("locality"), p["region"].alias("region"),
                p["country"].alias("country"), r["city"].alias("city"), r["province"].alias("province"),
            ),
        )

    def resolved(pair: Column) -> Column:
        return let(parted(pair), placed)

    return df.withColumn(
        "places", F.when(F.col("place_count") > 0, F.transform(both, resolved)).otherwise(F.array())
    )


def _flags(*pairs) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, name) for condition, name in pairs]))


def normalize_postings(
    df: DataFrame, json_col: str = "posting", page_url: str = "page_url", domain: str = "domain",
    captured_at: str = "captured_at", position: str = "position",
) -> DataFrame:
    """``df`` plus the observation columns of every posting in ``json_col``."""
    df = open_postings(df, json_col)
    salary, pay_value = "p_baseSalary", "p_pay"
    df = df.withColumns({n: F.expr(_sub(salary, f)) for n, f in _PAY_FIELDS.items()})
    df = df.withColumns({"p_low": _pay_bound("p_pay_min"), "p_high": _pay_bound("p_pay_max")})
    df = _tidy_texts(
        df,
        {
            "t_title": raw_text("p_title"),
            "t_name": raw_text("p_name"),
            "t_org": raw_text("p_hiringOrganization"),
            "t_employment": raw_text("p_employmentType"),
            "t_posted": raw_text("p_datePosted"),
            "t_through": raw_text("p_validThrough"),
            "t_remote": raw_text("p_jobLocationType"),
            "t_currency": raw_text(_sub(salary, "$.currency")),
            "t_unit": F.expr(f"case when {_is(pay_value, 'OBJECT')} then {_raw_text(_sub(pay_value, '$.unitText'))} end"),
            "t_unit2": raw_text(_sub(salary, "$.unitText")),
            "t_education": _first_education("p_educationRequirements"),
        },
    )
    df = df.withColumn("t_identifier", clean_text(identifier_text("p_identifier")))
    # A string is taken as written; other shapes go through the text coercion.
    df = df.withColumn("t_description", raw_text("p_description"))
    df = df.withColumn("t_description", description_text("t_description"))
    df = _address_texts(df)
    return _rules(df, page_url, domain, captured_at, position)


def _first_education(value: str) -> Column:
    """Credential text of the first requirement that has one."""
    v, t = f"x{next(_names)}", f"x{next(_names)}"
    one = f"case when {_is(v, 'OBJECT')} then {_raw_text(_sub(v, '$.credentialCategory'))} else {_raw_text(v)} end"
    return F.expr(f"get(filter(transform({_items(value)}, {v} -> {one}), {t} -> trim({t}) <> ''), 0)")


def _rules(df: DataFrame, page_url: str, domain: str, captured_at: str, position: str) -> DataFrame:
    c = F.col
    df = df.withColumn("source_title", F.coalesce("t_title", "t_name"))
    df = df.withColumn("employer", neutral_employer("t_org"))
    primary = F.get(c("places"), 0)
    df = df.withColumns(
        {
            "organization": c("employer.name"),
            "city": primary["city"],
            "province": primary["province"],
            "street": primary["street"],
            "locality_raw": primary["locality"],
            "region_raw": primary["region"],
            "country_raw": primary["country"],
            "location_count": c("place_count").cast("int"),
            "provinces": F.array_sort(
                F.array_distinct(F.array_compact(F.transform("places", lambda p: p["province"])))
            ),
            "countries": F.array_compact(F.transform("places", lambda p: F.lower(p["country"]))),
            "canonical_url": canonical_page_url(page_url),
            "salary_unit_raw": F.coalesce("t_unit", "t_unit2"),
            "pay": _structured_pay(),
            "captured_date": F.to_date(captured_at),
            "posted": parse_date(c("t_posted")),
            "through": parse_date(c("t_through")),
        }
    )
    bad_posted = (c("posted") > F.date_add("captured_date", limits.FUTURE_DAYS)) | (
        c("posted") < F.lit(limits.EARLIEST_POSTING).cast("date")
    )
    df = df.withColumn("date_posted", F.when(~bad_posted, c("posted")))
    inverted = F.coalesce(c("through") < c("date_posted"), F.lit(False))
    df = df.withColumn("valid_through", F.when(~inverted, c("through")))
    pay, title = c("pay"), c("source_title")
    disclosed = pay["status"] == "DISCLOSED"
    comparable = disclosed & F.coalesce(pay["currency"] == "IDR", F.lit(False))
    in_country = F.arrays_overlap(c("countries"), F.array(*[F.lit(w) for w in COUNTRY_WORDS]))
    untitled = title.isNull() | (F.length(title) < 3)
    no_date = F.coalesce(F.is_variant_null(c("p_datePosted")), F.lit(True))
    df = df.withColumns(
        {
            "invalid_reasons": _flags(
                (untitled, "missing_title"),
                (~untitled & title.rlike(f"(?iU){NOT_A_VACANCY}"), "not_a_vacancy"),
                (c("organization").isNull(), "missing_hiring_organization"),
                (is_placeholder_employer("organization", domain), "placeholder_hiring_organization"),
                ((F.size("countries") > 0) & ~in_country, "location_outside_indonesia"),
            ),
            "quality_flags": F.concat(
                _flags(
                    (c("employer.flag") == "EMPLOYER_CONFIDENTIAL", "EMPLOYER_CONFIDENTIAL"),
                    (c("employer.flag") == "EMPLOYER_HOUSEHOLD", "EMPLOYER_HOUSEHOLD"),
                    (c("province").isNull(), "PROVINCE_UNRESOLVED"),
                    (c("location_count") > 1, "MULTI_LOCATION"),
                    (c("posted").isNull() & no_date, "DATE_POSTED_MISSING"),
                    (c("posted").isNull() & ~no_date, "DATE_POSTED_UNPARSEABLE"),
                    (bad_posted, "DATE_POSTED_IMPLAUSIBLE"),
                    (inverted, "VALID_THROUGH_BEFORE_POSTED"),
                    (c("valid_through") < c("captured_date"), "EXPIRED_AT_CAPTURE"),
                    (c("t_description").isNull(), "DESCRIPTION_MISSING"),
                    (F.length("t_description") < limits.DESCRIBED_CHARS, "DESCRIPTION_THIN"),
                    ((pay["status"] != "NOT_DISCLOSED") & c("t_currency").isNull(),
                     "SALARY_CURRENCY_MISSING"),
                    ((pay["status"] != "NOT_DISCLOSED") & (pay["period"] == "UNKNOWN"),
                     "SALARY_PERIOD_MISSING"),
                ),
                F.when(pay["status"] != "NOT_DISCLOSED", pay["flags"]).otherwise(
                    F.array().cast("array<string>")
                ),
            ),
            "title": display_title(title, "organization"),
            "title_key": F.when(
                title.isNotNull(),
                title_key(title, "organization", "city", "province", "locality_raw", "region_raw", "street"),
            ),
            "organization_key": F.when(c("organization").isNotNull(), organization_key("organization")),
            "role_family": F.when(title.isNotNull(), role_family(title)),
            "employment_type_raw": c("t_employment"),
            "employment_type": employment_code("t_employment"),
            "work_arrangement": F.when(F.upper("t_remote") == "TELECOMMUTE", "REMOTE").otherwise("UNKNOWN"),
            "experience_min_years": _years("p_experienceRequirements"),
            "education_level": F.coalesce(
                lookup(CREDENTIALS, F.lower("t_education")), education_level("t_education", cleaned=True)
            ),
            "salary_status": pay["status"],
            "salary_currency": F.when(disclosed, pay["currency"]),
            "salary_period": pay["period"],
            "salary_min": F.when(disclosed, pay["minimum"]),
            "salary_max": F.when(disclosed, pay["maximum"]),
            "salary_monthly_min": F.when(comparable, pay["monthly_minimum"]),
            "salary_monthly_max": F.when(comparable, pay["monthly_maximum"]),
            "description_length": F.coalesce(F.length("t_description"), F.lit(0)),
            "description_sha1": F.sha1("t_description"),
            "skills": extract_skills("t_description"),
            "source_identifier": c("t_identifier"),
            "source_record_key": F.concat(c("canonical_url"), F.lit("#"), c(position).cast("string")),
            "record_key_kind": F.lit("page_url"),
            "source_domain": c(domain),
            "site_type": site_type(domain),
            "page_url_": c(page_url),
            "posting_position": c(position).cast("int"),
            "parser_version": F.lit(PARSER_VERSION),
        }
    )
    df = df.withColumn("is_valid", F.size("invalid_reasons") == 0)
    helpers = [n for n in df.columns if n.startswith(("t_", "p_"))] + [
        "employer", "places", "place_items", "place_parts", "place_text", "place_folded", "place_count", "countries", "pay",
        "posted", "through", "captured_date", "street",
    ]
    df = df.drop(*helpers, *( ["page_url"] if page_url != "page_url" else []))
    return df.drop("page_url").withColumnRenamed("page_url_", "page_url")


#: The parts of ``baseSalary`` that amounts are read from, taken out once per row.
_PAY_FIELDS = {"p_pay": "$.value", "p_pay_min": "$.value.minValue", "p_pay_max": "$.value.maxValue", "p_pay_value": "$.value.value"}


def _pay_bound(bound: str) -> Column:
    """Amount of one bound: the object's own, its single value where it states no bound, or the scalar value."""
    filled = "case when not is_variant_null({0}) then {0} end".format
    stated = f"coalesce({filled('p_pay_min')}, {filled('p_pay_max')}) is not null"
    nested = f"case when {stated} then {filled(bound)} else p_pay_value end"
    return F.when(
        F.expr(_is("p_baseSalary", "OBJECT")), _amount(f"case when {_is('p_pay', 'OBJECT')} then {nested} else p_pay end")
    )


def _structured_pay() -> Column:
    """Pay struct of ``baseSalary``: scalar or object value, unit text, currency spellings."""
    found = F.struct(F.col("p_low").alias("low"), F.col("p_high").alias("high"))
    unit = F.upper(F.coalesce("t_unit", "t_unit2"))
    code = F.upper("t_currency")
    given = F.struct(
        found.alias("amounts"), F.coalesce(lookup(CURRENCY_ALIASES, code), code).alias("currency"),
        F.when(unit.isin(*PAY_UNITS), unit).otherwise("UNKNOWN").alias("period"),
    )
    return let(
        given,
        lambda g: evaluate_amounts(g["amounts"]["low"], g["amounts"]["high"], g["currency"], g["period"]),
    )


def _years(raw: str) -> Column:
    months = F.expr(_scalar(_sub(raw, "$.monthsOfExperience"))).try_cast("double")
    return F.floor(months / 12).cast("int")
