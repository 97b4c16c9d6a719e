"""Thin adapters from the star-schema and event tables to the canonical tables.

Canonical ``offers`` (a row for each show, date, time and seller): show_id,
show_ord, date, time, source, source_ord, price_from, price_to, currency,
book_url, available. Canonical ``shows``: show_id, show_ord, title, venue,
venue_norm, source_count, min_price, max_price.

Events stand in for offers: a user is a show, an event type a seller, and the
hour gives one of two performances a day. Of several events for one performance
and seller the last counts.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime.date(2024, 1, 10)
NOW_MINUTES = 18 * 60
# Sellers in their order of preference.
SELLERS = ("purchase", "click", "view", "signup", "error")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seen(spark: SparkSession, sf_dir: str, start: datetime.date | None, stop: datetime.date | None) -> DataFrame:
    events = read(spark, sf_dir, "events")
    if start:
        events = events.where(F.col("ts") >= F.lit(datetime.datetime.combine(start, datetime.time())).cast("timestamp_ntz"))
    if stop:
        events = events.where(F.col("ts") < F.lit(datetime.datetime.combine(stop, datetime.time())).cast("timestamp_ntz"))
    k = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("show_id"), F.to_date("ts").alias("date"), F.when(F.hour("ts") < 17, "14:30").otherwise("19:30").alias("time"), F.col("event_type").alias("source"), F.col("value").alias("price_from"), k.alias("k"), F.col("ts").alias("seen_at"))


def _derived(seen: DataFrame) -> DataFrame:
    return seen.withColumns(
        {
            "show_ord": F.col("show_id"),
            "source_ord": F.array_position(F.array(*map(F.lit, SELLERS)), F.col("source")).cast("int"),
            "price_to": F.when(F.col("k") % 4 == 0, F.col("price_from") * F.lit(1.5)),
            "currency": F.lit("GBP"),
            "book_url": F.when(F.col("k") % 3 != 0, F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("show_id").cast("string"))),
            "available": F.when(F.col("k") < 10, False).when(F.col("k") < 80, True),
        }
    )


def observations(spark: SparkSession, sf_dir: str, start: datetime.date | None = None, stop: datetime.date | None = None) -> DataFrame:
    """Offers as they were seen, several for a performance and seller: ``seq``
    orders them. Performances from ``start`` to before ``stop`` only: the bounds
    stand on the stored column, so that the scan skips what it can."""
    return _derived(_seen(spark, sf_dir, start, stop))


def offers(spark: SparkSession, sf_dir: str, start: datetime.date | None = None, stop: datetime.date | None = None) -> DataFrame:
    """The last observation of each performance and seller. One shuffle by
    performance serves this step and all that follow by performance (few rows
    repeat, so nothing is lost by not summing before it); what follows from other
    columns is made after it, so it isn't moved."""
    key = ["show_id", "date", "time", "source"]
    last = _seen(spark, sf_dir, start, stop).repartition("show_id", "date", "time").groupBy(*key).agg(F.max_by(F.struct("price_from", "k"), "seq").alias("x"))
    columns = ["show_id", "show_ord", "date", "time", "source", "source_ord", "price_from", "price_to", "currency", "book_url", "available"]
    return _derived(last.select(*key, "x.price_from", "x.k")).select(*columns)


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows by customer, with the prices and sellers of all their offers."""
    found = offers(spark, sf_dir).groupBy("show_id").agg(
        F.min("price_from").alias("min_price"), F.coalesce(F.max("price_to"), F.max("price_from")).alias("max_price"), F.countDistinct("source").alias("source_count")
    )
    base = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed list of nations
    return (
        base.select(F.col("c_custkey").alias("show_id"), F.col("c_custkey").alias("show_ord"), F.col("c_name").alias("title"), F.col("n_name").alias("venue"), F.lower("n_name").alias("venue_norm"))
        .join(found, "show_id")
        .select("show_id", "show_ord", "title", "venue", "venue_norm", "source_count", "min_price", "max_price")
    )
