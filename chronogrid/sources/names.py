"""Dates, natural order and band tables from file names, and calendars of climate files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dates as names have them, most exact first: pattern, and what its groups are.  Fixed values.
DATE_PATTERNS = (
    (r"(?<![0-9])(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})T(\d{2})[-_:.]?(\d{2})[-_:.]?(\d{2})", "second"),
    (r"(?<![0-9])(\d{4})-(\d{2})-(\d{2})(?![0-9])", "day"),
    (r"(?<![0-9])(\d{4})[_.](\d{2})[_.](\d{2})(?![0-9])", "day"),
    (r"(?<![0-9])((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?![0-9])", "day"),
    (r"(?<![0-9])((?:19|20)\d{2})[-_.]?([0-3]\d{2})(?![0-9])", "ordinal"),
    (r"(?<![0-9])((?:19|20)\d{2})[-_.](0[1-9]|1[0-2])(?![0-9])", "month"),
    (r"(?<![0-9])((?:19|20)\d{2})(?![0-9])", "year"),
)


def date_of_name(name: Column) -> Column:
    """The date that a file's name has, as a timestamp; none without one.  An impossible date gives way to the next pattern."""
    out = []
    for pattern, kind in DATE_PATTERNS:
        g = lambda k, p=pattern: F.regexp_extract(name, p, k)
        day = {"month": "-01", "year": "-01-01"}.get(kind, "")
        if kind == "ordinal":
            n = F.try_to_number(g(2), F.lit("999")).cast("int")
            start = F.try_to_timestamp(F.concat(g(1), F.lit("-01-01")))
            out.append(F.when(n.between(1, 366), (start + F.make_dt_interval(n - 1)).cast("timestamp")))
        elif kind == "second":
            out.append(F.try_to_timestamp(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), g(4), F.lit(":"), g(5), F.lit(":"), g(6))))
        else:
            parts = [g(k) for k in range(1, {"day": 4, "month": 3, "year": 2}[kind])]
            out.append(F.try_to_timestamp(F.concat(F.concat_ws("-", *parts), F.lit(day))))
    return F.coalesce(*out)


def granularity(name: Column) -> Column:
    """How exact the date of a name is."""
    c = F.lit(None).cast("string")
    for pattern, kind in reversed(DATE_PATTERNS):
        c = F.when(name.rlike(pattern), "day" if kind == "ordinal" else kind).otherwise(c)
    return c


def natural_key(name: Column) -> Column:
    """Names sort by it as people count: runs of digits by their value."""
    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"\A\d"), F.lpad(F.regexp_replace(p, r"\A0+(?=\d)", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def bands_to_rows(wide: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """A column for each band to a row for each: keys, band, value."""
    return wide.unpivot(keys, bands, "band", "value")


#: Days of the year before each month, of a year without a leap day.  Fixed values.
MONTH_STARTS = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365)


def cf_time(value: Column, units: str, calendar: str = "standard") -> Column:
    """`value` in CF units such as `days since 2000-01-01` as a timestamp; calendars standard, noleap and 360_day."""
    unit, _, start = units.partition(" since ")
    seconds = {"days": 86400.0, "day": 86400.0, "hours": 3600.0, "hour": 3600.0, "minutes": 60.0, "seconds": 1.0}.get(unit.strip())
    if seconds is None or not start:
        raise ValueError(f"{units!r} isn't a unit of time since a date")
    date, _, clock = start.strip().replace("T", " ").partition(" ")
    y, m, d = (int(x) for x in date.split("-"))
    h, mi, s = ([float(x) for x in clock.rstrip("Z").split(":")] + [0.0, 0.0, 0.0])[:3] if clock else (0.0, 0.0, 0.0)
    since = F.lit(h * 3600 + mi * 60 + s) + value * F.lit(seconds)
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        return (F.unix_timestamp(F.lit(f"{y:04d}-{m:02d}-{d:02d} 00:00:00")) + since).cast("timestamp")
    if calendar in ("noleap", "365_day"):
        day = F.lit(y * 365 + MONTH_STARTS[m - 1] + d - 1) + F.floor(since / 86400.0)
        year, doy = F.floor(day / 365), F.pmod(day, F.lit(365))
        month = F.lit(1)
        for k in range(1, 12):
            month = F.when(doy >= MONTH_STARTS[k], k + 1).otherwise(month)
        of = doy - F.element_at(F.lit(list(MONTH_STARTS)), month.cast("int")) + 1
    elif calendar == "360_day":
        day = F.lit(y * 360 + (m - 1) * 30 + d - 1) + F.floor(since / 86400.0)
        year, month, of = F.floor(day / 360), F.floor(F.pmod(day, F.lit(360)) / 30) + 1, F.pmod(day, F.lit(30)) + 1
        last = F.dayofmonth(F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))))
        of = F.least(of.cast("int"), last)  # 30 February, and 29 in most years, is the last day of February
    else:
        raise ValueError(f"no calendar {calendar!r}")
    base = F.make_date(year.cast("int"), month.cast("int"), of.cast("int")).cast("timestamp")
    return (F.unix_timestamp(base) + F.pmod(since, F.lit(86400.0))).cast("timestamp")


def scaled(raw: Column, nodata: float | None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Stored numbers as values: none where they are the mark of no data."""
    v = raw.cast("double")
    return (v if nodata is None else F.when(v != nodata, v)) * scale + offset
