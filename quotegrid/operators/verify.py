"""Choosing each offer's price, state and address from what several checks found.

``FIELDS`` is the place to plug a source in: for each source, a Column factory
for each canonical field. ``project`` turns a source's performances into
canonical offers; their union is the input of the merge.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import SOURCE_PRIORITY
from ..functions.times import canonical_time

Field = Callable[[], Column]
c = F.col


def filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def nonzero(*numbers: Column) -> Column:
    """The first number that is neither null nor 0."""
    return F.coalesce(*[F.nullif(n, F.lit(0.0)) for n in numbers])


def in_stock(text: Column) -> Column:
    """Whether a non-empty availability says so; null for none."""
    return F.when(filled(text).isNotNull(), text.contains("InStock"))


def _is(column: str, value: str) -> Column:
    return F.coalesce(c(column) == value, F.lit(False))


NO_SEATS = "no_seats"


def _checked(first: Column, last: Column) -> Column:
    """A checked value before a listed one; none if the check saw no seats."""
    return F.when(_is("verified_price_source", NO_SEATS), None).otherwise(F.coalesce(first, last))


def _chip(value: str) -> Column:
    return F.when(_is("verified_chip_source", "chips"), c(value))


def _on_page(value: Column, otherwise: Column) -> Column:
    return F.when(_is("verified_price_source", NO_SEATS), False).otherwise(F.coalesce(F.when(_is("verified_price_source", "ticketing_page"), value), otherwise))


def _ttd_sold_out() -> Column:
    """The seat plan failed in the way it does for sold-out performances that the calendar still lists."""
    return _is("seat_price_source", "fetch_failed") & _is("seat_status", "result_code=-1") & _is("verified_price_source", "ttd_calendar")


FIELDS: dict[str, dict[str, Field]] = {
    "olt": {
        "price_from": lambda: _checked(c("verified_min_price"), c("min_price")),
        "price_to": lambda: _checked(c("verified_max_price"), c("max_price")),
        "currency": lambda: F.lit("GBP"),
        "book_url": lambda: c("book_url"),
        "available": lambda: _on_page(c("verified_available"), c("available")),
    },
    "todaytix": {
        "date": lambda: filled(c("local_date"), c("date")),
        "time": lambda: filled(c("local_time"), c("time")),
        "price_from": lambda: F.coalesce(F.when(_is("verified_price_source", "chips"), c("verified_min_price")), c("low_price_value")),
        "price_to": lambda: F.when(_is("verified_price_source", "chips"), c("verified_max_price")),
        "book_url": lambda: filled(c("booking_url"), c("book_url")),
        "available": lambda: c("seats_available") > 0,
    },
    "lovetheatre": {
        "price_from": lambda: nonzero(c("min_combined_price"), c("price")),
        "price_to": lambda: F.lit(None),
        "book_url": lambda: filled(c("book_url"), c("offer_url")),
        "available": lambda: F.coalesce(in_stock(c("availability")), c("max_seats") > 0),
    },
    "seatplan": {
        "price_from": lambda: F.coalesce(_chip("verified_chip_min"), _checked(c("verified_min_price"), c("low_price"))),
        "price_to": lambda: F.coalesce(_chip("verified_chip_max"), _checked(c("verified_max_price"), F.lit(None).cast("double"))),
        "available": lambda: _on_page(F.when(c("verified_min_price").isNotNull(), True), in_stock(c("availability"))),
    },
    "ttd": {
        "price_from": lambda: F.coalesce(
            F.when(_is("seat_price_source", "seat_plan"), c("seat_min_price")),
            F.when(~_ttd_sold_out() & ~_is("verified_price_source", "not_in_calendar"), F.coalesce(c("verified_min_price"), c("price"))),
        ),
        "price_to": lambda: F.when(_is("seat_price_source", "seat_plan"), c("seat_max_price")),
        "book_url": lambda: filled(c("verified_book_url"), c("book_url")),
        "available": lambda: in_stock(c("availability")),
    },
}
CANONICAL = {"date": "string", "time": "string", "price_from": "double", "price_to": "double", "currency": "string", "book_url": "string", "available": "boolean"}


def project(perfs: DataFrame, source: str, keys: tuple[str, ...] = ("rec_id", "raw_ord"), fields: Mapping[str, Mapping[str, Field]] = FIELDS) -> DataFrame:
    """Canonical offers of one source's performances; a field without a factory is taken by its name."""
    own = fields[source]
    out = [own[k]() if k in own else c(k) for k in CANONICAL]
    columns = [x.cast(t).alias(k) for x, (k, t) in zip(out, CANONICAL.items())]
    rank = SOURCE_PRIORITY.index(source) if source in SOURCE_PRIORITY else len(SOURCE_PRIORITY)
    return perfs.select(*keys, F.lit(source).alias("source"), F.lit(rank).alias("source_ord"), *columns).withColumn("time", canonical_time(c("time")))


def union_of(perfs: Mapping[str, DataFrame], keys: tuple[str, ...] = ("rec_id", "raw_ord")) -> DataFrame:
    """Offers of all sources, without those that lack a date or time or have nothing to offer."""
    out = None
    for source, df in perfs.items():
        own = project(df, source, keys)
        out = own if out is None else out.unionByName(own)
    named = "nullif(date, '') is not null and nullif(time, '') is not null"
    offering = "coalesce(price_from, price_to) is not null or currency is not null or book_url is not null or available is not null"
    return out.where(named).where(offering)


def band_low_price(bands: Column, low: Column, seats: Column) -> Column:
    """The lowest price of an array of bands (price_value, seats_available) with
    seats. Without any word of seats the advertised price stands; a performance
    without seats, or whose bands are all sold out, has none."""
    told = F.coalesce(F.exists(bands, lambda b: b["seats_available"].isNotNull()), F.lit(False))
    open_ = F.array_min(F.transform(F.filter(bands, lambda b: b["seats_available"] > 0), lambda b: b["price_value"]))
    return F.when(~told, low).when(seats == 0, None).otherwise(open_)


def price_suspect(low: Column, high: Column, listed: Column, floor: float = 15.0, ratio: float = 8.0, outlier: float = 2.0) -> Column:
    """Why a checked price range is looked at again; the first reason that holds, or null."""
    return F.when(low <= floor, "low_floor").when((low > 0) & (high / low > ratio), "wide_ratio").when((listed > 0) & (low / listed > outlier), "high_outlier")


def in_window(date: Column, as_of: datetime.date, days: int) -> Column:
    """Whether a date is from a day on, up to so many days later (inclusive)."""
    return date.between(F.lit(as_of), F.lit(as_of + datetime.timedelta(days=days)))


def scarce_suspect(date: Column, bands: Column, as_of: datetime.date, days: int = 14, seats: int = 3) -> Column:
    """Whether a performance of the next days has few seats in its cheapest open band."""
    first = F.array_min(F.transform(F.filter(bands, lambda b: b["seats_available"] > 0), lambda b: F.struct(b["price_value"], b["seats_available"])))
    return F.coalesce(in_window(date, as_of, days) & (first["seats_available"] < seats), F.lit(False))


def agrees(seat_price: Column, calendar_price: Column, within: float = 0.50) -> Column:
    """Whether two checks found the same price; null if one found none."""
    return F.abs(seat_price - calendar_price) <= within


def calendar_check(perfs: DataFrame, calendar: DataFrame, failed_months: DataFrame) -> DataFrame:
    """Each performance against a calendar of (date, time, price): ``ttd_calendar``
    with its price, ``fetch_failed`` if its month couldn't be read, else ``not_in_calendar``. The last of several calendar rows counts."""
    last = calendar.groupBy("date", "time").agg(F.max_by("price", "pos").alias("calendar_price"))
    joined = perfs.join(last, ["date", "time"], "left").join(failed_months.select("year", "month").distinct().withColumn("failed", F.lit(True)), (F.year("date") == c("year")) & (F.month("date") == c("month")), "left")
    state = F.when(c("calendar_price").isNotNull(), "ttd_calendar").when(c("failed"), "fetch_failed").otherwise("not_in_calendar")
    return joined.withColumn("verified_price_source", state).drop("year", "month", "failed")


def removed(old: DataFrame, new: DataFrame, as_of: datetime.date, days: int, fetch_ok: bool = True) -> DataFrame:
    """Performances that a calendar had and now only the page lists, inside the
    window: no seats and no availability. If the calendar couldn't be read at all, nothing counts as removed."""
    had = old.where(c("price_source").isin("calendar_api", "calendar_only")).select("perf_id", F.lit(True).alias("had"))
    gone = F.lit(fetch_ok) & F.coalesce(c("had"), F.lit(False)) & (c("price_source") == "jsonld_only") & in_window(c("date"), as_of, days)
    joined = new.join(had, "perf_id", "left").withColumn("removed", F.coalesce(gone, F.lit(False)))
    return joined.withColumns({"max_seats": F.when(c("removed"), 0).otherwise(c("max_seats")), "availability": F.when(c("removed"), "").otherwise(c("availability"))}).drop("had")


def cached(wanted: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Each wanted key (key, hash) against a cache (key, hash, stored_at, value):
    ``hit`` if the entry is young enough and made from the same inputs, else ``expired``, ``changed`` or ``miss``."""
    entry = cache.select("key", c("hash").alias("cache_hash"), "stored_at", "value")
    age = F.unix_timestamp(now) - F.unix_timestamp("stored_at")
    state = F.when(c("stored_at").isNull(), "miss").when(age >= ttl_seconds, "expired").when(~c("hash").eqNullSafe(c("cache_hash")), "changed").otherwise("hit")
    return wanted.join(entry, "key", "left").withColumn("state", state).withColumn("value", F.when(c("state") == "hit", c("value"))).drop("cache_hash", "stored_at")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
