"""Pay amounts: free text, structured amounts, plausibility flags, monthly equivalents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import any_phrase, as_column, clean_text, let, literal_map
from postlake.rules import limits
from postlake.rules.words import (
    AMOUNT_PATTERN, CURRENCY_PATTERNS, HIDDEN_PAY_PHRASES, MAGNITUDES, NEGOTIABLE_PHRASES,
    PERIOD_PATTERNS,
)



def to_monthly(amount: Column, period: Column) -> Column:
    """Monthly pay from monthly or yearly pay only; yearly/12 rounds half to even."""
    return F.when(period == "MONTH", amount).when(
        period == "YEAR", F.rint(amount / F.lit(12.0)).cast("bigint")
    )


def _flag(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), name)


def evaluate_amounts(
    minimum: Column, maximum: Column, currency: Column, period: Column,
    assumed: Column | None = None, flags: Column | None = None,
) -> Column:
    """struct(status, minimum, maximum, currency, period, period_assumed, flags, monthly_*).

    One known bound is an exact figure. Amounts <= 0 or out of order are INVALID. Implausible
    amounts stay and are flagged.
    """
    given = F.struct(
        F.coalesce(minimum, maximum).cast("bigint").alias("low"),
        F.coalesce(maximum, minimum).cast("bigint").alias("high"),
        (minimum.isNull() | maximum.isNull()).alias("single"),
        currency.cast("string").alias("currency"),
        period.cast("string").alias("period"),
        (F.lit(False) if assumed is None else assumed).alias("assumed"),
        (F.array().cast("array<string>") if flags is None else flags).alias("flags"),
    )
    return let(given, _evaluated)


def _evaluated(g: Column) -> Column:
    low, high, known = g["low"], g["high"], g["low"].isNotNull()
    monthly = F.struct(
        to_monthly(low, g["period"]).alias("low"), to_monthly(high, g["period"]).alias("high")
    )
    refused = (low <= 0) | (high <= 0)
    crossed = low > high
    idr = g["currency"] == "IDR"

    def build(m: Column) -> Column:
        names = F.concat(
            g["flags"],
            F.array_compact(
                F.array(
                    _flag(g["single"], "SALARY_SINGLE_VALUE"),
                    _flag(crossed, "SALARY_MIN_GREATER_THAN_MAX"),
                    _flag(~crossed & (high > limits.WIDE_RANGE * low), "SALARY_WIDE_RANGE"),
                    _flag(~crossed & idr & (m["high"] > limits.PAY_CEILING), "SALARY_HIGH_OUTLIER"),
                    _flag(~crossed & idr & (m["low"] < limits.PAY_FLOOR), "SALARY_LOW_OUTLIER"),
                )
            ),
        )
        return F.struct(
            F.when(~known, "NOT_DISCLOSED").when(refused | crossed, "INVALID").otherwise("DISCLOSED")
            .alias("status"),
            low.alias("minimum"), high.alias("maximum"),
            F.when(known, g["currency"]).alias("currency"),
            F.when(known, g["period"]).otherwise("UNKNOWN").alias("period"),
            (known & g["assumed"]).alias("period_assumed"),
            F.when(known & ~refused, names).otherwise(F.array().cast("array<string>")).alias("flags"),
            m["low"].alias("monthly_minimum"), m["high"].alias("monthly_maximum"),
        )

    return let(monthly, build)


def parse_number(token: Column) -> Column:
    """A number with Indonesian or English separators, as double.

    With both kinds present the last one is the decimal mark. One kind used once is a
    thousands mark only before exactly three digits; used repeatedly it always is.
    """

    def number(t: Column) -> Column:
        no_comma = F.replace(t, F.lit(","), F.lit(""))
        no_dot = F.replace(t, F.lit("."), F.lit(""))
        both = t.contains(".") & t.contains(",")
        grouped = t.rlike(r"^\d+([.,]\d+){2,}$") | t.rlike(r"[.,]\d{3}$")
        plain = (
            F.when(both & t.rlike(r"\.[^.,]*$"), no_comma)
            .when(both, F.replace(no_dot, F.lit(","), F.lit(".")))
            .when(grouped, F.replace(no_dot, F.lit(","), F.lit("")))
            .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        )
        return plain.try_cast("double")

    return let(token, number)


def _first_match(text: Column, patterns) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), code) for code, pattern in patterns])


def _amounts(text: Column) -> Column:
    """struct(low, high): the first two amounts of lower-cased text, rounded half to even."""
    scales = literal_map(MAGNITUDES)
    found = F.struct(
        F.regexp_extract_all(text, F.lit(AMOUNT_PATTERN), F.lit(1)).alias("numbers"),
        F.regexp_extract_all(text, F.lit(AMOUNT_PATTERN), F.lit(2)).alias("words"),
    )

    def scaled(f: Column) -> Column:
        return F.struct(
            parse_number(F.get(f["numbers"], 0)).alias("a"),
            parse_number(F.get(f["numbers"], 1)).alias("b"),
            F.coalesce(F.try_element_at(scales, F.get(f["words"], 0)), F.lit(1)).alias("sa"),
            F.coalesce(F.try_element_at(scales, F.get(f["words"], 1)), F.lit(1)).alias("sb"),
        )

    def rounded(s: Column) -> Column:
        # "5 - 7 juta": a bare small first number shares the second one's magnitude.
        shared = s["b"].isNotNull() & (s["sa"] == 1) & (s["sb"] > 1) & (s["a"] < 1000)
        return F.struct(
            F.rint(s["a"] * F.when(shared, s["sb"]).otherwise(s["sa"])).try_cast("bigint").alias("low"),
            F.rint(s["b"] * s["sb"]).try_cast("bigint").alias("high"),
        )

    return let(let(found, scaled), rounded)


def parse_salary(
    value: Column | str, default_currency: str | None = None, assumed_period: str | None = None,
    cleaned: bool = False,
) -> Column:
    """Parse pay text; see ``evaluate_amounts`` for the struct. The defaults state a documented
    convention of the source and are used (and recorded) only where the text is silent."""
    return let(
        F.lower(as_column(value) if cleaned else clean_text(value)),
        lambda text: _parsed(text, default_currency, assumed_period),
    )


def _parsed(text: Column, default_currency: str | None, assumed_period: str | None) -> Column:
    hidden = text.isNull() | any_phrase(text, HIDDEN_PAY_PHRASES)
    seen = F.struct(
        F.when(~hidden, _amounts(text)).alias("amounts"),
        _first_match(text, CURRENCY_PATTERNS).alias("currency"),
        _first_match(text, PERIOD_PATTERNS).alias("period"),
        hidden.alias("hidden"),
    )

    def judged(s: Column) -> Column:
        flags = F.array_compact(
            F.array(_flag(s["currency"].isNull() & F.lit(default_currency is not None),
                          "SALARY_CURRENCY_ASSUMED"))
        )
        pay = evaluate_amounts(
            s["amounts"]["low"], s["amounts"]["high"],
            F.coalesce(s["currency"], F.lit(default_currency).cast("string")),
            F.coalesce(s["period"], F.lit(assumed_period).cast("string"), F.lit("UNKNOWN")),
            s["period"].isNull() & F.lit(assumed_period is not None), flags,
        )
        silent = F.when(any_phrase(text, NEGOTIABLE_PHRASES), "NEGOTIABLE").otherwise("UNPARSEABLE")
        return let(
            pay,
            lambda p: p.withField(
                "status",
                F.when(s["hidden"], "NOT_DISCLOSED").when(p["minimum"].isNull(), silent)
                .otherwise(p["status"]),
            ),
        )

    return let(seen, judged)
