"""The effective offer of each performance, and what follows from one day's or window's offers.

``eff`` is what ``effective`` returns: show_id, show_ord, date, time, seller,
price, seller_count. Ties go to the source first in order, then to the show
first in order, then to the earlier performance.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prices, times

PERF = ["show_id", "show_ord", "date", "time"]


def lit_date(d: datetime.date) -> Column:
    return F.lit(d).cast("date")


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank. Groups are ranked inside
    their partition with a limit on the map side, so a large group costs k rows a task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def ranked(df: DataFrame, group: Sequence[Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """All rows with their rank in an order, without bringing them into one task:
    ``group`` are expressions (never null) by which the order goes first, such as
    its first column or the first letters of it. Ranks are counted inside the
    groups and moved by the sizes of the groups before."""
    keys = [f"__g{i}" for i in range(len(group))]
    marked = df.withColumns(dict(zip(keys, group)))
    before = F.coalesce(F.sum("__size").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each group
    sizes = marked.groupBy(*keys).agg(F.count("*").alias("__size")).select(*keys, before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return marked.withColumn("__own", own).join(sizes, keys).withColumn(name, c_int("__own") + c_int("__before")).drop(*keys, "__own", "__before")


def c_int(name: str) -> Column:
    return F.col(name).cast("int")


def limited(df: DataFrame, k: int, order: str) -> DataFrame:
    """The first k rows, for what is costly after it: every task hands on k rows at most."""
    return df.orderBy(order).limit(k)


def first_rows(df: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of all, with their rank."""
    few = df.orderBy(*order).limit(k)
    return few.withColumn(name, F.row_number().over(Window.orderBy(*order)))  # k rows


def effective(offers: DataFrame, respect_availability: bool = True) -> DataFrame:
    """For each performance with one, the cheapest valid offer that isn't known
    to be unavailable, and how many there are."""
    ok = prices.valid_price(F.col("price_from"))
    if respect_availability:
        ok = ok & F.coalesce(F.col("available"), F.lit(True))
    return offers.where(ok).groupBy(*PERF).agg(
        F.min_by("source", F.struct("price_from", "source_ord")).alias("seller"), F.min("price_from").alias("price"), F.count("*").alias("seller_count")
    )


def upcoming(shows: DataFrame, offers: DataFrame, as_of: datetime.date) -> DataFrame:
    """Shows with a performance on or after a day."""
    return shows.join(offers.where(F.col("date") >= lit_date(as_of)).select("show_id").distinct(), "show_id", "left_semi")


def for_date(eff: DataFrame, day: datetime.date) -> DataFrame:
    """All performances of a day, by price and time."""
    return eff.where(F.col("date") == lit_date(day)).select("show_id", "time", "seller", "price", "seller_count").orderBy("price", "time", "show_id")


def best_of_day(eff: DataFrame) -> DataFrame:
    """For each date and show, the cheapest performance (the earlier of equals)."""
    return eff.groupBy("date", "show_id", "show_ord").agg(F.min_by(F.struct("time", "seller", "price"), F.struct("price", "time")).alias("x")).select("date", "show_id", "show_ord", "x.time", "x.seller", "x.price")


def top_shows(eff: DataFrame, k: int = 5) -> DataFrame:
    """For each date, the k cheapest shows: date, rank, show_id, time, price."""
    return top(best_of_day(eff), ["date"], [F.col("price"), F.col("show_ord")], k).select("date", "rank", "show_id", "time", "price")


def tonight(eff: DataFrame, as_of: datetime.date, now: int) -> DataFrame:
    """Performances of today that start after the cutoff."""
    return eff.where((F.col("date") == lit_date(as_of)) & ~times.imminent_or_past(F.col("time"), now))


def tonight_stats(eff: DataFrame, as_of: datetime.date, now: int, under: float = 35.0) -> DataFrame:
    return tonight(eff, as_of, now).agg(
        F.min("price").alias("floor"), F.count("*").alias("perf_count"), F.countDistinct("show_id").alias("show_count"), F.countDistinct(F.when(F.col("price") < under, F.col("show_id"))).alias("under_count")
    )


def spine(spark: SparkSession, start: datetime.date, days: int) -> DataFrame:
    """One row for each of so many days."""
    return spark.range(1).select(F.explode(F.sequence(lit_date(start), lit_date(start + datetime.timedelta(days=days - 1)))).alias("date"))


def day_floors(eff: DataFrame) -> DataFrame:
    return eff.groupBy("date").agg(F.min("price").alias("floor"), F.countDistinct("show_id").alias("show_count"), F.count("*").alias("perf_count"))


def bucketed_days(days: DataFrame, floors: DataFrame) -> DataFrame:
    """Days with floor, show_count, perf_count, is_dark, and the price bucket 1-5
    by the percentiles of the lit days' floors (null if dark). Days are few: a row for each day of the calendar."""
    joined = days.join(floors, "date", "left")
    cuts = joined.agg(prices.cut_points(F.collect_list("floor")).alias("cuts"))
    return joined.join(F.broadcast(cuts)).select(
        "date", "floor", F.coalesce("show_count", F.lit(0)).alias("show_count"), F.coalesce("perf_count", F.lit(0)).alias("perf_count"), F.col("floor").isNull().alias("is_dark"), F.when(F.col("floor").isNotNull(), prices.bucket(F.col("floor"), F.col("cuts"))).alias("bucket")
    )


def between(df: DataFrame, start: datetime.date, days: int) -> DataFrame:
    return df.where((F.col("date") >= lit_date(start)) & (F.col("date") < lit_date(start + datetime.timedelta(days=days))))


def week_days(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """The next seven days; a dark day is in bucket 5."""
    days = bucketed_days(spine(eff.sparkSession, as_of, 7), day_floors(between(eff, as_of, 7)))
    return days.select("date", "floor", "show_count", "is_dark", F.coalesce("bucket", F.lit(5)).alias("bucket"))


def week_best(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """For each show of the week its cheapest performance and the range of its dearer ones."""
    week = between(eff, as_of, 7)
    best = week.groupBy("show_id", "show_ord").agg(F.min_by(F.struct("date", "time", "price"), F.struct("price", "date", "time")).alias("x"), F.collect_list("price").alias("all"))
    others = F.filter("all", lambda p: p > F.col("x.price"))
    low, high = F.array_min(others), F.array_max(others)
    return best.select("show_id", "x.date", "x.time", "x.price", low.alias("other_low"), high.alias("other_high"), prices.range_label(low, high).alias("other_range"))


def month_start(as_of: datetime.date) -> tuple[datetime.date, int]:
    first = as_of.replace(day=1)
    return first, ((first + datetime.timedelta(days=32)).replace(day=1) - first).days


def month_days(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """All days of the month, the past ones too; buckets from 0 to 4, null if dark."""
    first, n = month_start(as_of)
    days = bucketed_days(spine(eff.sparkSession, first, n), day_floors(between(eff, first, n)))
    return days.select("date", "floor", "is_dark", (F.col("date") < lit_date(as_of)).alias("is_past"), (F.col("bucket") - 1).alias("bucket"))


def cheapest_weeknight(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """The cheapest Monday to Thursday from today on in this month (the earliest of equals), with the first show at that price."""
    first, n = month_start(as_of)
    days = between(eff, as_of, (first + datetime.timedelta(days=n) - as_of).days).where(F.weekday("date") <= 3)
    return days.agg(F.min_by(F.struct("date", "price", "show_id"), F.struct("price", "date", "show_ord", "time")).alias("x")).where("x is not null").select("x.date", "x.price", "x.show_id")


def widest_range(shows: DataFrame, offers: DataFrame, as_of: datetime.date) -> DataFrame:
    """Of shows with a performance left this month, the one whose prices lie farthest apart."""
    first, n = month_start(as_of)
    left = between(offers, as_of, (first + datetime.timedelta(days=n) - as_of).days).select("show_id").distinct()
    ok = shows.where(prices.valid_price(F.col("min_price")) & prices.valid_price(F.col("max_price"))).join(left, "show_id", "left_semi")
    return ok.withColumn("range", F.col("max_price") - F.col("min_price")).orderBy(F.desc("range"), "show_ord").limit(1).select("show_id", "title", "range")


def month_activity(offers: DataFrame, eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """Shows that play this month, and dates with an offer."""
    first, n = month_start(as_of)
    a = between(offers, first, n).agg(F.countDistinct("show_id").alias("show_count"))
    return a.join(F.broadcast(between(eff, first, n).agg(F.countDistinct("date").alias("date_count"))))  # single rows


def weekend_dates(as_of: datetime.date) -> list[datetime.date]:
    """The days of the weekend ahead: Friday to Sunday; on Friday and Saturday what is left after today."""
    dow = as_of.weekday()
    if dow in (4, 5):
        return [as_of + datetime.timedelta(days=i) for i in range(1, 7 - dow)]
    friday = as_of + datetime.timedelta(days=(4 - dow) % 7)
    return [friday + datetime.timedelta(days=i) for i in range(3)]


def weekend_days(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    days = weekend_dates(as_of)
    found = day_floors(between(eff, days[0], len(days)))
    return spine(eff.sparkSession, days[0], len(days)).join(found, "date", "left").select("date", "floor", F.coalesce("show_count", F.lit(0)).alias("show_count"), F.col("floor").isNull().alias("is_dark"))


def weekend_top(eff: DataFrame, as_of: datetime.date, k: int = 3) -> DataFrame:
    days = weekend_dates(as_of)
    return top_shows(between(eff, days[0], len(days)), k)


def _matinee_eff(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    return eff.where(F.col("date") >= lit_date(as_of)).withColumns({"week": F.date_trunc("week", F.col("date").cast("timestamp_ntz")).cast("date"), "hour": times.hour(F.col("time"))}).where("hour is not null")


def matinee_rows(eff: DataFrame, as_of: datetime.date, k: int = 8) -> DataFrame:
    """For each calendar week from today on, the k cheapest shows with a matinee, and what that saves against their evenings."""
    early = F.col("hour") < times.MATINEE_BEFORE
    per_show = _matinee_eff(eff, as_of).groupBy("week", "show_id", "show_ord").agg(
        F.min_by(F.when(early, F.struct("date", "time", "price")), F.when(early, F.struct("price", "date", "time"))).alias("x"), F.min(F.when(~early, F.col("price"))).alias("evening_price")
    )
    rows = per_show.where("x is not null").select("week", "show_id", "show_ord", "x.date", "x.time", "x.price", "evening_price")
    saved = F.when(F.col("evening_price") > F.col("price"), prices.js_round(F.col("evening_price") - F.col("price")))
    return top(rows, ["week"], [F.col("price"), F.col("show_ord")], k).select("week", "rank", "show_id", "date", "time", "price", "evening_price", saved.alias("savings"))


def matinee_weeks(eff: DataFrame, offers: DataFrame, as_of: datetime.date) -> DataFrame:
    """Every week up to the last performance: matinees with an offer and their floor."""
    monday = as_of - datetime.timedelta(days=as_of.weekday())
    last = F.greatest(F.max("date"), lit_date(as_of))
    weeks = offers.agg(last.alias("last")).select(F.explode(F.sequence(lit_date(monday), F.coalesce("last", lit_date(as_of)), F.expr("interval 7 days"))).alias("week"))
    found = _matinee_eff(eff, as_of).where(F.col("hour") < times.MATINEE_BEFORE).groupBy("week").agg(F.count("*").alias("perf_count"), F.min("price").alias("floor"))
    return weeks.join(found, "week", "left").select("week", F.coalesce("perf_count", F.lit(0)).alias("perf_count"), "floor", times.week_label(F.col("week"), F.date_add("week", 6)).alias("label"))


# Tiers as (name, from, below).
TIERS = (("under20", 0.0, 20.0), ("20to30", 20.0, 30.0), ("30to40", 30.0, 40.0), ("40plus", 40.0, float("inf")))


def price_tiers(eff: DataFrame, as_of: datetime.date, days: int = 30, tiers=TIERS) -> DataFrame:
    """For each tier of shows' best prices in the window: how many shows, and the cheapest one."""
    best = between(eff, as_of, days).groupBy("show_id", "show_ord").agg(F.min("price").alias("price"))
    name = F.lit(None).cast("string")
    for t, low, below in tiers:
        name = F.when((F.col("price") >= low) & (F.col("price") < below), t).otherwise(name)
    found = best.withColumn("tier", name).groupBy("tier").agg(F.count("*").alias("n"), F.min_by(F.struct("show_id", "price"), F.struct("price", "show_ord")).alias("x"))
    names = eff.sparkSession.createDataFrame([(i, t) for i, (t, _, _) in enumerate(tiers)], "tier_ord int, tier string")
    return F.broadcast(names).join(found, "tier", "left").select("tier_ord", "tier", F.coalesce("n", F.lit(0)).alias("show_count"), F.col("x.show_id").alias("headline_show"), F.col("x.price").alias("headline_price"))


def closing_soon(eff: DataFrame, offers: DataFrame, as_of: datetime.date, days: int = 30, k: int = 8) -> DataFrame:
    """Shows whose last performance is within so many days (inclusive) and that have an offer; all performances count as remaining."""
    last = _future(offers, as_of).groupBy("show_id", "show_ord").agg(F.max("date").alias("last_date"), F.count("*").alias("remaining"))
    floor = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id").agg(F.min("price").alias("floor"))
    rows = last.where(F.col("last_date") <= lit_date(as_of + datetime.timedelta(days=days))).join(floor, "show_id").withColumn("days_left", F.date_diff("last_date", lit_date(as_of)))
    return _ranked(rows, "days_left", k, ["show_id", "last_date", "days_left", "remaining", "floor"])


def _future(offers: DataFrame, as_of: datetime.date) -> DataFrame:
    """A row for each performance on or after a day, whatever its offers."""
    return offers.where(F.col("date") >= lit_date(as_of)).select(*PERF).distinct()


def _ranked(rows: DataFrame, by: str, k: int, columns: list[str]) -> DataFrame:
    """The first k rows by one column and show order, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total_count"))
    return first_rows(rows, [F.col(by), F.col("show_ord")], k).join(F.broadcast(total)).select("rank", *columns, "total_count")  # one row


def opening_soon(eff: DataFrame, offers: DataFrame, as_of: datetime.date, days: int = 21, k: int = 6) -> DataFrame:
    """Shows whose first performance is after today and within so many days
    (inclusive): floors of the first seven days and of the whole run. The floor of
    a run is never above that of its first days, so savings are always null."""
    first = _future(offers, as_of).groupBy("show_id", "show_ord").agg(F.min("date").alias("first_date"))
    rows = first.where((F.col("first_date") > lit_date(as_of)) & (F.col("first_date") <= lit_date(as_of + datetime.timedelta(days=days))))
    floors = rows.join(eff.where(F.col("date") >= lit_date(as_of)).select("show_id", "date", "price"), "show_id", "left").groupBy("show_id", "show_ord", "first_date").agg(
        F.min(F.when(F.col("date") < F.date_add("first_date", 7), F.col("price"))).alias("preview_floor"), F.min("price").alias("run_floor")
    )
    out = floors.withColumns({"days_out": F.date_diff("first_date", lit_date(as_of)), "preview_savings": F.when(F.col("run_floor") > F.col("preview_floor"), prices.js_round(F.col("run_floor") - F.col("preview_floor")))})
    return _ranked(out, "days_out", k, ["show_id", "first_date", "days_out", "preview_floor", "run_floor", "preview_savings"])


def best_nights(eff: DataFrame, as_of: datetime.date, days: int = 90, near: int = 14, middle: int = 30, far: int = 60) -> DataFrame:
    """Four picks of days, each cheapest among those left (the earliest of
    equals): soon; a weekend day; a later day; a Monday to Thursday after the
    middle horizon. Day floors are a row for each day of the window."""
    day = lambda n: lit_date(as_of + datetime.timedelta(days=n))
    floors = day_floors(between(eff, as_of, days)).select("date", "floor", "perf_count")
    wants = [F.col("date") < day(near), (F.col("date") < day(middle)) & (F.weekday("date") >= 5), (F.col("date") >= day(middle)) & (F.col("date") < day(far)), (F.col("date") >= day(middle)) & (F.weekday("date") <= 3)]
    picks = None
    for i, want in enumerate(wants):
        left = floors if picks is None else floors.join(F.broadcast(picks.select("date")), "date", "left_anti")  # three rows at most
        one = left.where(want).orderBy("floor", "date").limit(1).select(F.lit(i + 1).alias("pick"), "date", "floor", "perf_count")
        picks = one if picks is None else picks.unionByName(one)
    return picks


def weekday_distribution(eff: DataFrame, as_of: datetime.date, days: int = 60) -> DataFrame:
    """For each weekday (Monday = 0), the day floors of the window: upper median,
    least, largest, how many, whether cheap (within 2 of the least median), and whether it has the widest spread."""
    floors = day_floors(between(eff, as_of, days)).groupBy(F.weekday("date").alias("dow")).agg(F.array_sort(F.collect_list("floor")).alias("p"))
    spread = F.array_max("p") - F.array_min("p")
    cells = floors.select("dow", F.element_at("p", F.floor(F.size("p") / 2).cast("int") + 1).alias("median"), F.array_min("p").alias("low"), F.array_max("p").alias("high"), F.size("p").alias("n"), spread.alias("spread"))
    all_ = cells.agg(F.min("median").alias("least"), F.max_by("dow", F.struct("spread", -F.col("dow"))).alias("widest"))
    names = eff.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
    return names.join(cells, "dow", "left").join(F.broadcast(all_)).select("dow", "median", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("median") <= F.col("least") + 2, F.lit(False)).alias("cheap"), F.coalesce(F.col("dow") == F.col("widest"), F.lit(False)).alias("widest"))


def monthly_calendar(eff: DataFrame, as_of: datetime.date, days: int = 90) -> DataFrame:
    """All days of the months that the window touches: floor, performances,
    bucket (1-5, null without a floor), whether in the window, and whether dark (in it and without a floor)."""
    first, stop = as_of.replace(day=1), as_of + datetime.timedelta(days=days)
    after, n = month_start(stop)
    grid = spine(eff.sparkSession, first, (after + datetime.timedelta(days=n) - first).days)
    inside = (F.col("date") >= lit_date(as_of)) & (F.col("date") < lit_date(stop))
    return bucketed_days(grid, day_floors(between(eff, as_of, days))).select("date", inside.alias("in_window"), "floor", "perf_count", "bucket", (inside & F.col("is_dark")).alias("is_dark"))


def other_dates(eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """For each show and future date with an offer, the range of its offers on its
    other dates. Two sums for each show and date, and their complements, need no self-join."""
    future = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id", "date").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    before = Window.partitionBy("show_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("show_id").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    low = F.least(F.min("low").over(before), F.min("low").over(after))
    high = F.greatest(F.max("high").over(before), F.max("high").over(after))
    return future.withColumns({"other_low": low, "other_high": high}).select("show_id", "date", "other_low", "other_high", prices.range_label(F.col("other_low"), F.col("other_high")).alias("label"))


def today_feed(offers: DataFrame, eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """All performances of today, also without an offer, by start, price (none last) and show."""
    day = _future(offers, as_of).where(F.col("date") == lit_date(as_of))
    return day.join(eff.where(F.col("date") == lit_date(as_of)).select("show_id", "time", "seller", "price"), ["show_id", "time"], "left").select("time", "show_id", "seller", "price").orderBy("time", F.asc_nulls_last("price"), "show_id")


def month_grid(eff: DataFrame, offers: DataFrame, as_of: datetime.date) -> DataFrame:
    """For each show, its future days: floor, bucket by the show's own day floors, and a compact label of its times."""
    days = _future(offers, as_of).groupBy("show_id", "date").agg(F.collect_set("time").alias("times"))
    floors = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id", "date").agg(F.min("price").alias("floor"))
    cuts = floors.groupBy("show_id").agg(prices.cut_points(F.collect_list("floor")).alias("cuts"))
    out = days.join(floors, ["show_id", "date"], "left").join(cuts, "show_id", "left")
    return out.select("show_id", "date", "floor", F.when(F.col("floor").isNotNull(), prices.bucket(F.col("floor"), F.col("cuts"))).alias("bucket"), times.compact_times(F.col("times")).alias("times"))
