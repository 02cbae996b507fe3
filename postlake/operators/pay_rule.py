"""The one rule that decides whether a salary is comparable, reused by every view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.rules import limits


def monthly_midpoint(low: str = "salary_monthly_min", high: str = "salary_monthly_max") -> Column:
    return (F.col(low) + F.col(high)) / F.lit(2.0)


def monthly_idr_recorded() -> Column:
    """Disclosed IDR pay with both monthly bounds, before plausibility."""
    return (
        F.coalesce((F.col("salary_status") == "DISCLOSED") & (F.col("salary_currency") == "IDR"), F.lit(False))
        & F.col("salary_monthly_min").isNotNull()
        & F.col("salary_monthly_max").isNotNull()
    )


def comparable_salary(floor: int = limits.PAY_FLOOR) -> Column:
    plausible = (F.col("salary_monthly_min") <= F.col("salary_monthly_max")) & (monthly_midpoint() >= floor)
    return monthly_idr_recorded() & F.coalesce(plausible, F.lit(False))


def reliable_salary(floor: int = limits.PAY_FLOOR) -> Column:
    """Vacancy-level form: marked reliable and at or above the floor."""
    return F.coalesce(F.col("salary_reliable") & (monthly_midpoint() >= floor), F.lit(False))
