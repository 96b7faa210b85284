"""Relative date literals as half-open ranges, and the calendar functions of the query dialect.

A literal is resolved before the plan is made, against an explicit anchor day, so that a comparison is a range
predicate on the bare column and reaches the Parquet scan.
"""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SUNDAY = 6


def _month(d: date, n: int) -> date:
    """The first day of the month ``n`` months after that of ``d``."""
    at = d.year * 12 + d.month - 1 + n
    return date(at // 12, at % 12 + 1, 1)


def date_range(literal: str, anchor: date, week_start: int = SUNDAY, fiscal_start: int = 1) -> tuple[date, date]:
    """[lo, hi) of a literal such as TODAY, LAST_N_MONTHS:3 or THIS_FISCAL_QUARTER.

    LAST_N and NEXT_N units are whole units beside the current one; days count from the anchor and include it for
    LAST_N_DAYS. N_<units>_AGO is the one unit that long ago.
    """
    name, _, count = literal.upper().partition(":")
    n, day = int(count) if count else 1, timedelta(days=1)
    if name in ("YESTERDAY", "TODAY", "TOMORROW"):
        lo = anchor + day * ("YESTERDAY", "TODAY", "TOMORROW").index(name) - day
        return lo, lo + day
    if name in ("LAST_90_DAYS", "NEXT_90_DAYS"):
        name, n = name.replace("90", "N"), 90
    if name == "LAST_N_DAYS":
        return anchor - day * n, anchor + day
    if name == "NEXT_N_DAYS":
        return anchor + day, anchor + day * (n + 1)
    if name == "N_DAYS_AGO":
        return anchor - day * n, anchor - day * (n - 1)
    words = name.split("_")
    unit = words[-2] if words[-1] == "AGO" else words[-1]
    unit = unit.removesuffix("S")
    fiscal = "FISCAL" in words

    def start(k: int) -> date:
        """The first day of the k-th unit after the current one."""
        if unit == "WEEK":
            return anchor - timedelta(days=(anchor.weekday() - week_start) % 7) + timedelta(days=7 * k)
        shift = fiscal_start - 1 if fiscal else 0
        size = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
        back = (anchor.month - 1 - shift) % size
        return _month(anchor, size * k - back)

    if words[-1] == "AGO":
        return start(-n), start(1 - n)
    if words[0] == "LAST":
        return start(-n), start(0)
    if words[0] == "NEXT":
        return start(1), start(n + 1)
    if words[0] == "THIS":
        return start(0), start(1)
    raise ValueError(f"no date literal {literal}")


def date_predicate(col: Column, op: str, literal: str, anchor: date, **how: int) -> Column:
    """A comparison with a relative literal: = in range, != outside, < before it, <= up to its end, > after, >= from it."""
    lo, hi = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in date_range(literal, anchor, **how))
    return {
        "=": (col >= lo) & (col < hi), "!=": (col < lo) | (col >= hi), "<": col < lo, "<=": col < hi, ">": col >= hi, ">=": col >= lo,
    }[op]


def days_in(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


def week_in_month(col: Column) -> Column:
    return F.ceil(F.dayofmonth(col) / 7).cast("int")


def week_in_year(col: Column) -> Column:
    return F.ceil(F.dayofyear(col) / 7).cast("int")


def fiscal_month(col: Column, start: int = 1) -> Column:
    return F.month(F.add_months(col, 1 - start))


def fiscal_quarter(col: Column, start: int = 1) -> Column:
    return F.quarter(F.add_months(col, 1 - start))


def fiscal_year(col: Column, start: int = 1) -> Column:
    """The year in which the fiscal year ends."""
    return F.year(F.add_months(col, (13 - start) % 12))
