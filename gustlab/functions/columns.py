"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_name(name: str) -> str:
    """Spark-safe snake case: ``active.power.kW`` -> ``active_power_kw``."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def qcol(name: str) -> Column:
    """Column by exact name (names with dots stay literal)."""
    return F.col(f"`{name}`")


def null_if_nan(c: Column) -> Column:
    """NaN -> NULL: Spark ``avg``/``max`` would propagate NaN where R/SQL skip missing values."""
    return F.nanvl(c, F.lit(None).cast("double"))


def parse_number(c: Column) -> Column:
    """Text with ``,`` thousands marks -> double; unparsable -> NULL.

    ``try_cast`` keeps bad cells as NULL instead of failing the task under ANSI mode.
    """
    return F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")


def round_half_even(c: Column, digits: int) -> Column:
    """R's ``round`` is half-even."""
    return F.bround(c, digits)


def month_label(c: Column) -> Column:
    """``"01-2017"`` -> ``"Jan2017"`` (A5)."""
    return F.date_format(F.to_date(F.concat(F.lit("01-"), c), "dd-MM-yyyy"), "MMMyyyy")


def parse_dmy_hm(c: Column) -> Column:
    """``dd/MM/yyyy HH:mm`` text -> timestamp_ntz, NULL when the text is not a timestamp.

    Built from the parts, never through a zoned timestamp, so no session zone moves an hour of a clock change.
    """
    t = F.trim(c)
    part = lambda i: F.nullif(F.regexp_extract(t, r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2})$", i), F.lit("")).cast("int")
    day, month, year, hour, minute = (part(i) for i in range(1, 6))
    first = F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))
    ok = day.between(1, F.dayofmonth(F.last_day(first))) & hour.between(0, 23) & minute.between(0, 59) & (year > 0)
    guard = lambda x: F.when(ok, x)
    return F.make_timestamp_ntz(guard(year), guard(month), guard(day), guard(hour), guard(minute), F.lit(0))


def split_timestamp(df: DataFrame, ts: str = "ts", prefix: str = "",
                    parts: Iterable[str] = ("year", "month", "day", "hour", "minute", "second")) -> DataFrame:
    """Timestamp -> calendar parts as integer columns."""
    fns = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
           "minute": F.minute, "second": F.second}
    return df.withColumns({f"{prefix}{p}": fns[p](F.col(ts)) for p in parts})


def unite_timestamp(year: Column, month: Column, day: Column, hour: Column | None = None,
                    minute: Column | None = None, second: Column | None = None) -> Column:
    """Calendar parts -> timestamp_ntz."""
    z = F.lit(0)
    return F.make_timestamp_ntz(year, month, day, hour if hour is not None else z,
                                minute if minute is not None else z,
                                second if second is not None else z)


def add_years(ts: Column, years: int) -> Column:
    """Month-safe year shift: 29 Feb + 1 year = 28 Feb, like lubridate ``%m+%``."""
    return ts + F.make_interval(F.lit(years))


def add_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def add_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def dms_to_decimal(c: Column) -> Column:
    """``"deg min sec"`` text -> decimal degrees (B21). Sign of the degrees applies to the whole value."""
    parts = F.split(F.trim(c), r"\s+")
    deg = F.get(parts, F.lit(0)).try_cast("double")
    mins = F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0))
    secs = F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
    mag = F.abs(deg) + mins / 60.0 + secs / 3600.0
    return F.when(F.trim(c).startswith("-"), -mag).otherwise(mag)


def any_null(cols: Iterable[str]) -> Column:
    cs = [qcol(c).isNull() for c in cols]
    out = F.lit(False)
    for c in cs:
        out = out | c
    return out


def all_present(cols: Iterable[str]) -> Column:
    return ~any_null(cols)
