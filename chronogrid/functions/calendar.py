"""Dates: periods, decimal years, slices, durations.  All in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the units of a trailing window.
WINDOW_DAYS = {"d": 1.0, "w": 7.0, "m": 30.4375, "y": 365.25}


def timestamp(ts: Column) -> Column:
    return ts.cast("timestamp")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_seconds(timestamp(ts))


def micros(ts: Column) -> Column:
    return F.unix_micros(timestamp(ts))


def year_days(ts: Column) -> Column:
    y = F.year(ts)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(leap, F.lit(366)).otherwise(F.lit(365))


def decimal_year(ts: Column) -> Column:
    """The year and the share of it that has passed."""
    seconds = epoch(ts) - epoch(F.date_trunc("year", timestamp(ts)))
    return F.year(ts) + seconds / (year_days(ts) * F.lit(86400.0))


def day_365(ts: Column) -> Column:
    """Day of a year of 365 days: 29 February shares its number with 1 March."""
    doy, leap = F.dayofyear(ts), year_days(ts) == 366
    return F.when(leap & (doy >= 60), doy - 1 + F.when(doy == 60, 1).otherwise(0)).otherwise(doy)


def week_52(ts: Column) -> Column:
    return F.least(F.ceil(day_365(ts) / 7).cast("int"), F.lit(52))


def season_year(ts: Column, start: int) -> Column:
    """The year in which the season that begins on day `start` began."""
    return F.when(F.dayofyear(ts) >= start, F.year(ts)).otherwise(F.year(ts) - 1)


def season_bin(ts: Column, bins: int) -> Column:
    return F.floor((F.dayofyear(ts) - 1) * bins / 366).cast("int")


#: name of a period: its number, consecutive where the period has a year
PERIODS = {
    "year": lambda ts: F.year(ts),
    "quarter": lambda ts: F.year(ts) * 4 + F.quarter(ts) - 1,
    "month": lambda ts: F.year(ts) * 12 + F.month(ts) - 1,
}
#: numbers of the parts of a 365-day year
PARTS = {"quarter": (4, lambda ts: F.quarter(ts)), "month": (12, lambda ts: F.month(ts)), "week": (52, week_52), "doy": (365, day_365)}


def duration(text: str) -> tuple[float, str]:
    """`90d`, `2w`, `3m`, `1y` as number and unit."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([dwmy])", text)
    if not m:
        raise ValueError(f"{text!r} is no duration such as 90d, 2w, 3m or 1y")
    return float(m[1]), m[2]


def window_seconds(text: str) -> int:
    n, unit = duration(text)
    return round(n * WINDOW_DAYS[unit] * 86400)


def shifted(ts: Column, text: str) -> Column:
    """The moment a duration before `ts`; months and years keep the day where there is one, at midnight."""
    n, unit = duration(text)
    if unit in "dw":
        return F.timestamp_seconds(epoch(ts) - int(n * WINDOW_DAYS[unit] * 86400))
    return F.add_months(F.to_date(ts), -int(n) * (12 if unit == "y" else 1)).cast("timestamp")


def bound(text: str, upper: bool) -> str:
    """First day of `2019`, `2019-06` or `2019-06-15`, or the first day after it."""
    parts = [int(x) for x in text.split("-")]
    if upper:
        if len(parts) == 1:
            parts = [parts[0] + 1]
        elif len(parts) == 2:
            parts = [parts[0] + parts[1] // 12, parts[1] % 12 + 1]
    y, m, d = (parts + [1, 1])[:3]
    return f"{y:04d}-{m:02d}-{d:02d}"


def in_slice(ts: Column, lo: str, hi: str) -> Column:
    """Whether a date lies in the calendar slice lo .. hi, both included; months alone may wrap around the year's end."""
    if re.fullmatch(r"\d{1,2}", lo) and re.fullmatch(r"\d{1,2}", hi):
        a, b, m = int(lo), int(hi), F.month(ts)
        return m.between(a, b) if a <= b else (m >= a) | (m <= b)
    last = F.lit(bound(hi, True)).cast("date") if len(hi.split("-")) < 3 else F.date_add(F.lit(bound(hi, False)).cast("date"), 1)
    return (timestamp(ts) >= F.lit(bound(lo, False)).cast("timestamp")) & (timestamp(ts) < last.cast("timestamp"))
