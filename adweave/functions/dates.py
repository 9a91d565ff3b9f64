"""Dates: how exactly a time is known, windows, closing times, wordings.

All times are UTC.  ``precision`` is exact, day or unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A day may have begun or ended this much earlier or later elsewhere.
DAY_MARGIN = "INTERVAL 3 HOURS"


def latest_possible(posted: Column, precision: Column) -> Column:
    """The latest time that a posting can have; null where it isn't known."""
    return F.when(precision == "exact", posted).when(precision == "day", F.date_trunc("day", posted) + F.expr("INTERVAL 1 DAY") + F.expr(DAY_MARGIN))


def earliest_possible(posted: Column, precision: Column) -> Column:
    return F.when(precision == "exact", posted).when(precision == "day", F.date_trunc("day", posted) - F.expr(DAY_MARGIN))


def window_start(started: Column, hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(started) - hours * 3600)


def days_back(hours: Column) -> Column:
    """Whole days that cover the hours, one at least."""
    return F.greatest(F.lit(1), F.ceil(hours / 24)).cast("int")


def freshness(posted: Column, precision: Column, start: Column) -> Column:
    """fresh, too_old or unknown; only what is proven old is too old."""
    latest = latest_possible(posted, precision)
    return F.when(latest.isNull(), "unknown").when(latest >= start, "fresh").otherwise("too_old")


def parse_iso(s: Column) -> Column:
    """An ISO time or date; without a zone it is UTC; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(s), "(\\.\\d{6})\\d+", "$1"))


def end_of_day(day: Column, zone: str | Column = "UTC") -> Column:
    """23:59 of a date in ``zone``, as UTC."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 23:59:00"))), zone)


def day_at_utc(day: Column) -> Column:
    """Midday UTC of a date, the same day everywhere."""
    return F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")))


def parse_closing(s: Column) -> Column:
    """A closing time; a date alone lasts until its end."""
    trimmed = F.trim(s)
    return F.when(F.length(trimmed) == 10, end_of_day(F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")))).otherwise(parse_iso(trimmed))


def precision_of(local: Column) -> Column:
    """A local time at midnight is only a day."""
    return F.when(local.isNull(), "unknown").when(F.date_format(local, "HH:mm:ss") == "00:00:00", "day").otherwise("exact")


def relative_day(s: Column, today: Column) -> Column:
    """The date that "today", "yesterday" or "N days ago" means; else null."""
    low = F.lower(s)
    n = F.regexp_extract(low, "(\\d+)\\+? days? ago", 1)
    return F.when(low.contains("today"), today).when(low.contains("yesterday"), F.date_sub(today, 1)).when(n != "", F.date_sub(today, n.try_cast("int")))


def day_without_year(s: Column, today: Column) -> Column:
    """"27 Aug" in this year, or in the last one if that is over a day ahead."""
    this = F.to_date(F.try_to_timestamp(F.concat_ws(" ", s, F.year(today).cast("string")), F.lit("d MMM yyyy")))
    return F.when(this > F.date_add(today, 1), F.add_months(this, -12)).otherwise(this)
