"""Next times of cron expressions and intervals."""

from __future__ import annotations

import calendar
import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that fields may use.
MONTHS = dict(zip("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), range(1, 13)))
DAYS = dict(zip("SUN MON TUE WED THU FRI SAT".split(), range(7)))


def _numbers(field: str, low: int, high: int, names: dict | None = None) -> set[int]:
    def value(x: str) -> int:
        return names[x.upper()] if names and x.upper() in names else int(x)

    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = (value(x) for x in span.split("-"))
        else:
            a = value(span)
            b = high if step else a
        out.update(range(a, b + 1, int(step or 1)))
    return out


def _day_of_month(field: str, day: dt.date) -> bool:
    last = calendar.monthrange(day.year, day.month)[1]
    if field == "L":
        return day.day == last
    if field.endswith("W"):
        target = dt.date(day.year, day.month, min(int(field[:-1]), last))
        if target.weekday() == 5:
            target += dt.timedelta(days=2 if target.day == 1 else -1)
        elif target.weekday() == 6:
            target += dt.timedelta(days=-2 if target.day == last else 1)
        return day == target
    return day.day in _numbers(field, 1, 31)


def _day_of_week(field: str, day: dt.date) -> bool:
    now = (day.weekday() + 1) % 7
    if "#" in field:
        which, _, nth = field.partition("#")
        return now == _numbers(which, 0, 7, DAYS).pop() % 7 and (day.day - 1) // 7 + 1 == int(nth)
    if field.upper().endswith("L") and len(field) > 1:
        last = calendar.monthrange(day.year, day.month)[1]
        return now == _numbers(field[:-1], 0, 7, DAYS).pop() % 7 and day.day + 7 > last
    return now in {x % 7 for x in _numbers(field, 0, 7, DAYS)}


def cron_next(expression: str, after: dt.datetime) -> dt.datetime | None:
    """The first minute after ``after`` that all five fields allow (day of month and day of week both); None within eight years."""
    minute, hour, dom, month, dow = expression.split()
    minutes, hours = sorted(_numbers(minute, 0, 59)), sorted(_numbers(hour, 0, 23))
    months = _numbers(month, 1, 12, MONTHS)
    start = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    day = start.date()
    for _ in range(8 * 366):
        if day.month in months and _day_of_month(dom, day) and _day_of_week(dow, day):
            for h in hours:
                for m in minutes:
                    at = dt.datetime(day.year, day.month, day.day, h, m)
                    if at >= start:
                        return at
        day += dt.timedelta(days=1)
    return None


def cron_next_udf(expressions: Column, after: Column) -> Column:
    """``cron_next`` of two columns; null where either is."""

    def work(expressions: pd.Series, after: pd.Series) -> pd.Series:
        asked = [None if e is None or pd.isna(a) else (e, a.to_pydatetime().replace(second=0, microsecond=0)) for e, a in zip(expressions, after)]
        found = {q: cron_next(*q) for q in set(asked) - {None}}  # each expression and minute once
        return pd.Series([q and found[q] for q in asked], dtype="datetime64[us]")

    return F.pandas_udf(work, "timestamp_ntz")(expressions, after)
