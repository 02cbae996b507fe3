"""The filter model shared by search and every statistic, so they describe the same rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.pay_rule import comparable_salary
from postlake.rules import limits, vocab

# filter name -> job column
LIST_FILTERS = {
    "province": "province", "city": "city", "role_family": "role_family",
    "employment_type": "employment_type", "work_arrangement": "work_arrangement",
    "education": "education_level", "experience": "experience_band", "source": "primary_source_id",
}
CODES = {
    "role_family": vocab.ROLE_FAMILY, "employment_type": vocab.EMPLOYMENT_TYPE,
    "work_arrangement": vocab.WORK_ARRANGEMENT, "education": vocab.EDUCATION_LEVEL,
    "experience": vocab.EXPERIENCE_BAND, "freshness": vocab.FRESHNESS,
}


@dataclass(frozen=True)
class JobFilters:
    """Several values of one filter mean OR; different filters combine with AND.

    ``strict_codes`` checks coded filters against the vocabularies; switch it off for tables
    with other codes.
    """

    q: str | None = None
    province: tuple[str, ...] = ()
    city: tuple[str, ...] = ()
    role_family: tuple[str, ...] = ()
    employment_type: tuple[str, ...] = ()
    work_arrangement: tuple[str, ...] = ()
    education: tuple[str, ...] = ()
    experience: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    freshness: tuple[str, ...] = ()
    salary_disclosed: bool | None = None
    salary_min: int | None = None
    salary_max: int | None = None
    strict_codes: bool = field(default=True, compare=False)

    def __post_init__(self) -> None:
        if self.q is not None and len(self.q) > limits.MAX_QUERY_LENGTH:
            raise ValueError(f"q must have at most {limits.MAX_QUERY_LENGTH} characters")
        for name in (*LIST_FILTERS, "tag", "freshness"):
            values = getattr(self, name)
            if isinstance(values, str):
                raise TypeError(f"{name} takes a sequence of values")
            if len(values) > limits.MAX_FILTER_VALUES:
                raise ValueError(f"{name} takes at most {limits.MAX_FILTER_VALUES} values")
            if any(len(v) > limits.MAX_VALUE_LENGTH for v in values):
                raise ValueError(f"each {name} value must have at most {limits.MAX_VALUE_LENGTH} characters")
            if self.strict_codes and name in CODES and not set(values) <= set(CODES[name]):
                raise ValueError(f"unknown {name} code")
        texts = [self.q or "", *self.province, *self.city, *self.source, *self.tag]
        if any("\x00" in t for t in texts):
            raise ValueError("values must not contain NUL characters")
        for bound in (self.salary_min, self.salary_max):
            if bound is not None and not 0 <= bound <= limits.MAX_SALARY_BOUND:
                raise ValueError("salary bounds must lie between 0 and 10,000,000,000")
        if None not in (self.salary_min, self.salary_max) and self.salary_min > self.salary_max:
            raise ValueError("salary_min must not exceed salary_max")

    @property
    def query(self) -> str | None:
        return (self.q or "").strip() or None

    def terms(self) -> list[str]:
        return self.query.casefold().split() if self.query else []  # MAX_QUERY_LENGTH bounds them

    def without(self, name: str) -> JobFilters:
        return replace(self, **{name: ()})


def lifecycle(
    as_of: datetime | Column, window_days: int = limits.LIFECYCLE_DAYS,
    last_seen: str = "last_seen_at", expires: str = "expires_at",
) -> Column:
    """EXPIRED_BY_SOURCE, POTENTIALLY_ACTIVE or NOT_SEEN_RECENTLY; the three partition all rows.

    The window edge is inside, an expiry equal to ``as_of`` is not yet expired, and expiry
    wins over recency.
    """
    now = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")
    cutoff = now - F.make_dt_interval(F.lit(window_days))
    return (
        F.when(F.col(expires) < now, "EXPIRED_BY_SOURCE")
        .when(F.col(last_seen) >= cutoff, "POTENTIALLY_ACTIVE")
        .otherwise("NOT_SEEN_RECENTLY")
    )


def predicate(
    filters: JobFilters, as_of: datetime | None = None, window_days: int = limits.LIFECYCLE_DAYS
) -> Column:
    """All filters as one boolean column (the optimizer pushes its parts to the scan)."""
    parts = [F.col("search_text").contains(term) for term in filters.terms()]
    for name, column in LIST_FILTERS.items():
        values = getattr(filters, name)
        if values:
            parts.append(F.col(column).isin(*values))
    if filters.tag:
        parts.append(F.arrays_overlap("source_tags", F.array(*[F.lit(t) for t in filters.tag])))
    if filters.salary_disclosed is not None:
        disclosed = F.col("salary_status") == "DISCLOSED"
        parts.append(disclosed if filters.salary_disclosed else ~disclosed)
    if filters.salary_min is not None or filters.salary_max is not None:
        parts.append(comparable_salary())
    if filters.salary_min is not None:
        parts.append(F.col("salary_monthly_max") >= filters.salary_min)
    if filters.salary_max is not None:
        parts.append(F.col("salary_monthly_min") <= filters.salary_max)
    if filters.freshness:
        if as_of is None:
            raise ValueError("a freshness filter needs as_of")
        parts.append(lifecycle(as_of, window_days).isin(*filters.freshness))
    return reduce(Column.__and__, parts, F.lit(True))


def apply_filters(
    jobs: DataFrame, filters: JobFilters | None, as_of: datetime | None = None,
    window_days: int = limits.LIFECYCLE_DAYS,
) -> DataFrame:
    return jobs if filters is None else jobs.filter(predicate(filters, as_of, window_days))
