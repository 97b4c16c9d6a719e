"""What views choose by default and how they label what they show."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import format_price
from .offers import lit_date, ranked

c = F.col


def default_dates(perfs: DataFrame, as_of: datetime.date) -> DataFrame:
    """For each show the date that is chosen first: today, else the next one, else the last."""
    today = lit_date(as_of)
    return perfs.groupBy("show_id").agg(F.coalesce(F.min(F.when(c("date") >= today, c("date"))), F.max("date")).alias("date"))


def default_day(days: DataFrame, as_of: datetime.date) -> DataFrame:
    """Of a week's days (date, is_dark): today, else the first lit one, else the first."""
    return days.agg(first_lit(c("date"), c("is_dark"), as_of).alias("date"))


def first_lit(date: Column, is_dark: Column, as_of: datetime.date) -> Column:
    """An aggregate: today if it is among the dates, else the first lit one, else the first."""
    today = lit_date(as_of)
    return F.coalesce(F.max(F.when(date == today, today)), F.min(F.when(~is_dark, date)), F.min(date))


def sorted_ranks(rows: DataFrame) -> DataFrame:
    """Rows of a day (show_id, show_ord, time, price, title, venue) with their places in the orders of price, time, venue and title."""
    orders = {"by_price": ([F.floor("price")], ["price", "show_ord", "time"]), "by_time": ([c("time")], ["time", "show_ord"]), "by_venue": ([c("venue")], ["venue", "show_ord", "time"]), "by_title": ([F.substring("title", 1, 12)], ["title", "show_ord", "time"])}
    for name, (group, order) in orders.items():
        rows = ranked(rows, group, [c(x) for x in order], name)
    return rows


def venue_search(venues: DataFrame, words: str) -> DataFrame:
    return venues.where(F.lower("display_name").contains(words.strip().lower()))


def short_venue(venue: Column) -> Column:
    """Without `` Theatre`` at the end, in either case."""
    return F.regexp_replace(F.coalesce(venue, F.lit("")), r"(?i) Theatre$", "")


def swarm(points: DataFrame, by: str, value: str, order: str, step: float = 5.0) -> DataFrame:
    """Offsets that fan equal values of a column sideways around its middle."""
    same = Window.partitionBy(by, value)
    at = F.row_number().over(same.orderBy(order)) - 1
    return points.withColumn("offset", (at - (F.count("*").over(same) - 1) / 2.0) * step)


def axis_top(values: Column, least: int = 20, room: int = 5) -> Column:
    """The top of a price axis: the largest value with room, up to the next ten."""
    return F.greatest(F.lit(least), (F.ceil((F.coalesce(F.max(values), F.lit(0.0)) + room) / 10) * 10).cast("int"))


def bar_widths(rows: DataFrame, value: str, least: float = 8.0) -> DataFrame:
    """Each row's share of the widest one in percent, ``least`` at least. The widest comes from one row of sums."""
    widest = rows.agg(F.max(value).alias("widest"))
    return rows.join(F.broadcast(widest)).withColumn("width", F.greatest(F.lit(least), c(value) / c("widest") * 100)).drop("widest")


def closing_badge(days_left: Column) -> Column:
    return F.when(days_left == 0, "final").when(days_left <= 7, "critical").otherwise("")


def opening_label(days_out: Column) -> Column:
    return F.when(days_out == 0, "OPENS TODAY").when(days_out == 1, "OPENS TOMORROW").otherwise(F.concat(F.lit("OPENS IN "), days_out.cast("string"), F.lit(" DAYS")))


def range_text(low: Column, high: Column) -> Column:
    """``£a–£b``, one price, ``up to £b``, or null."""
    return F.when(low.isNull() & high.isNull(), None).when(low.isNull(), F.concat(F.lit("up to "), format_price(high))).when(high.isNull() | (low == high), format_price(low)).otherwise(F.concat(format_price(low), F.lit("–"), format_price(high)))


def months_needed(perfs: DataFrame, as_of: datetime.date, most: int = 6) -> DataFrame:
    """For each show, the first months with a performance from a day on."""
    months = perfs.where(c("date") >= lit_date(as_of)).select("show_id", F.year("date").alias("year"), F.month("date").alias("month")).distinct()
    return months.withColumn("n", F.row_number().over(Window.partitionBy("show_id").orderBy("year", "month"))).where(c("n") <= most).drop("n")


def meta(shows: DataFrame, perfs: DataFrame, generated_at: str | None) -> DataFrame:
    """One row about an export: when it was made (empty if unknown), shows, performances."""
    a = shows.agg(F.count("*").alias("show_count"))
    b = perfs.agg(F.count("*").alias("performance_count"))
    return a.join(F.broadcast(b)).select(F.lit(generated_at or "").alias("generated_at"), "show_count", "performance_count")  # single rows


def history_of(history: DataFrame, show_id: str, date: str, time: str) -> DataFrame:
    """The rows of one performance, oldest first; none if there is no such one."""
    return history.where((c("show_id") == show_id) & (c("date") == date) & (c("time") == time)).orderBy("seq")
