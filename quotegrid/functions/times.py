"""Dates and times of performances as expressions. Dates are DATE, times text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUTOFF_MINUTES = 20
MATINEE_BEFORE = 17


def minutes(time: Column) -> Column:
    """Minutes after midnight of ``H:MM`` or ``HH:MM...``; null if it isn't one or out of range."""
    h, m = F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 1).try_cast("int"), F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 2).try_cast("int")
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def imminent_or_past(time: Column, now: int) -> Column:
    """Whether a performance of today starts within the cutoff or has started; false for an unknown time."""
    return F.coalesce(minutes(time) < now + CUTOFF_MINUTES, F.lit(False))


def canonical_time(time: Column) -> Column:
    """``HH:MM`` from what begins with ``H:MM``; other texts as they are; empty as null."""
    h, m = F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 1), F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 2)
    return F.when(time == "", None).when(h != "", F.concat(F.lpad(h, 2, "0"), F.lit(":"), m)).otherwise(time)


def hour(time: Column) -> Column:
    return F.regexp_extract(time, r"^(\d{1,2})", 1).try_cast("int")


def twelve_hour(text: Column) -> Column:
    """``HH:MM`` from ``7.30pm``, ``7:30 PM``, ``7-30pm`` or ``7pm``; null if it isn't one."""
    pattern = r"(?i)^\s*(\d{1,2})(?:[:.\-](\d{2}))?\s*([ap])\.?m\.?"
    h, m, half = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    h12 = h.try_cast("int")
    h24 = F.when(F.lower(half) == "p", h12 % 12 + 12).otherwise(h12 % 12)
    return F.when((h12 >= 1) & (h12 <= 12), F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), F.when(m == "", "00").otherwise(m)))


def iso_split(iso: Column) -> tuple[Column, Column]:
    """The date and the ``HH:MM`` of an ISO text as written, without any shift of zone; no time without a ``T``."""
    date = F.substring(iso, 1, 10)
    time = F.when(iso.contains("T"), F.substring(F.split_part(iso, F.lit("T"), F.lit(2)), 1, 5))
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date), F.when(time.rlike(r"^\d{2}:\d{2}$"), time)


def nearest_year_date(day: Column, month: Column, near: Column) -> Column:
    """The date with this day and month that is nearest to another one; years
    without the date don't count, of two equally near ones the earlier."""
    years = F.array(*[F.year(near) + k for k in (-1, 0, 1)])
    dates = F.filter(F.transform(years, lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")), lambda d: d.isNotNull())
    return F.array_min(F.transform(dates, lambda d: F.struct(F.abs(F.date_diff(d, near)).alias("far"), d.alias("date"))))["date"]


def relative_time(then: Column, now: Column) -> Column:
    """``5m ago``, ``3h ago``, ``2d ago``, ``4w ago`` by rounded seconds; a dash for null."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    half_up = lambda unit: F.floor(seconds / unit + 0.5).cast("string")
    return (
        F.when(seconds.isNull(), "—")
        .when(F.floor(seconds / 60 + 0.5) < 60, F.concat(half_up(60), F.lit("m ago")))
        .when(F.floor(seconds / 3600 + 0.5) < 24, F.concat(half_up(3600), F.lit("h ago")))
        .when(F.floor(seconds / 86400 + 0.5) < 7, F.concat(half_up(86400), F.lit("d ago")))
        .otherwise(F.concat(half_up(604800), F.lit("w ago")))
    )


def short_label(date: Column) -> Column:
    """``Wed 10 Jan``"""
    return F.date_format(date, "EEE d MMM")


def week_label(start: Column, stop: Column) -> Column:
    """``8–14 JAN``, or ``29 JAN–4 FEB`` over two months."""
    month = lambda d: F.upper(F.date_format(d, "MMM"))
    day = lambda d: F.dayofmonth(d).cast("string")
    return F.when(F.month(start) == F.month(stop), F.concat(day(start), F.lit("–"), day(stop), F.lit(" "), month(stop))).otherwise(F.concat(day(start), F.lit(" "), month(start), F.lit("–"), day(stop), F.lit(" "), month(stop)))


def run_label(first: Column, last: Column) -> Column:
    """One day's label, or two joined by a dash."""
    return F.when(first == last, short_label(first)).otherwise(F.concat(short_label(first), F.lit(" – "), short_label(last)))


def compact_times(times: Column) -> Column:
    """Sorted times with commas; more than two as ``3 PERFS``."""
    return F.when(F.size(times) > 2, F.concat(F.size(times).cast("string"), F.lit(" PERFS"))).otherwise(F.array_join(F.array_sort(times), ", "))
