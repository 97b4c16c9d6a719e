"""Price history: a row is appended when something changed.

A history row: show_id, date, time, t (the run's stamp, compared as text), seq
(rises with each append), min, max, currency, any_available, sources (an array
of structs sorted by source, which compares where a map would not).
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
KEY = ["show_id", "date", "time"]
PAYLOAD = ["min", "max", "currency", "any_available", "sources"]
SCHEMA = "show_id string, date string, time string, t string, seq long, min double, max double, currency string, any_available boolean, sources array<struct<source: string, price_from: double, price_to: double, available: boolean>>"


def snapshot(perfs: DataFrame, offers: DataFrame, t: str) -> DataFrame:
    """This run's row of each performance; sources with no price and no state are left out."""
    told = offers.where("price_from is not null or price_to is not null or available is not null")
    sources = told.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("source", "price_from", "price_to", "available"))).alias("sources"))
    none = F.expr("cast(array() as array<struct<source: string, price_from: double, price_to: double, available: boolean>>)")
    return perfs.join(sources, KEY, "left").select(*KEY, F.lit(t).alias("t"), c("min_price").alias("min"), c("max_price").alias("max"), "currency", "any_available", F.coalesce("sources", none).alias("sources"))


def last_of(history: DataFrame) -> DataFrame:
    """The last row of each performance."""
    rest = [x for x in history.columns if x not in KEY]
    return history.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(*KEY, *[f"x.{r}" for r in rest])


def decide(history: DataFrame, snap: DataFrame) -> DataFrame:
    """The snapshot's rows with their fate: ``append`` (new or anything but the
    stamp differs from the last row, nulls being equal), ``replay`` (the last row has this stamp already) or ``same``."""
    payload = [x for x in PAYLOAD if x in snap.columns]
    last = last_of(history).select(*KEY, c("t").alias("__t"), c("seq").alias("__seq"), F.struct(*payload).alias("__last"))
    changed = ~F.struct(*payload).eqNullSafe(c("__last"))
    fate = F.when(c("__t").isNull(), "append").when(c("__t") == c("t"), "replay").when(changed, "append").otherwise("same")
    return snap.join(last, KEY, "left").withColumns({"fate": fate, "seq": F.coalesce("__seq", F.lit(0)) + 1}).drop("__t", "__seq", "__last")


def append(history: DataFrame, snap: DataFrame) -> DataFrame:
    """The history with the changed rows behind it. Running it again with the same snapshot adds nothing."""
    return history.unionByName(decide(history, snap).where("fate = 'append'").select(*history.columns))


def prune(history: DataFrame, live: DataFrame, as_of: datetime.date) -> DataFrame:
    """Without performances before a day, malformed dates, and shows that aren't live any more."""
    return history.where(F.try_to_date(c("date").cast("string"), "yyyy-MM-dd") >= F.lit(as_of)).join(live.select("show_id").distinct(), "show_id", "left_semi")


def stats(history: DataFrame, snap: DataFrame, live: DataFrame, as_of: datetime.date) -> DataFrame:
    """One row: appended, suppressed (same or replayed), pruned."""
    fate = decide(history, snap).agg(F.count_if(c("fate") == "append").alias("appended"), F.count_if(c("fate") != "append").alias("suppressed"))
    now = append(history, snap)
    kept, all_ = prune(now, live, as_of).agg(F.count("*").alias("kept")), now.agg(F.count("*").alias("rows"))
    return fate.join(F.broadcast(all_)).join(F.broadcast(kept)).select("appended", "suppressed", (c("rows") - c("kept")).alias("pruned"))  # single rows


def save_by_performance(history: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """The history as a table (in a folder of its own, or in the warehouse) that is
    dealt by performance once, when it is written: appends, lookups and ``as_of``
    join it without moving its rows."""
    writer = history.write.bucketBy(buckets, *KEY).sortBy(*KEY).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return history.sparkSession.table(table)


def append_to(table: str, snap: DataFrame, buckets: int = 64) -> DataFrame:
    """Appends the changed rows of a snapshot to such a table. Only the snapshot is shuffled."""
    spark = snap.sparkSession
    history = spark.table(table)
    decide(history, snap).where("fate = 'append'").select(*history.columns).write.bucketBy(buckets, *KEY).sortBy(*KEY).mode("append").saveAsTable(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def as_of(history: DataFrame, asks: DataFrame, at: str = "at") -> DataFrame:
    """Each ask (a performance and a place ``at`` in the order of ``seq``, with other
    columns) and what the history said then: its row with the largest seq up to
    ``at``, or nulls. A row holds until the next one of its performance, so an ask
    meets one row; a performance's rows are the times that its price changed."""
    rest = [x for x in history.columns if x not in KEY]
    until = F.lead("seq").over(Window.partitionBy(*KEY).orderBy("seq"))
    spans = history.select(*[c(k).alias(f"__{k}") for k in KEY], *rest, until.alias("__until"))
    same = [asks[k] == spans[f"__{k}"] for k in KEY]
    holds = (asks[at] >= spans["seq"]) & (spans["__until"].isNull() | (asks[at] < spans["__until"]))
    return asks.join(spans, [*same, holds], "left").drop("__until", *[f"__{k}" for k in KEY])


def price_change(history: DataFrame, key: list[str] = KEY, price: str = "min", order: str = "seq") -> DataFrame:
    """For each performance the newest valid price against the nearest earlier one that differs: delta and percent, null without one."""
    valid = history.where(f"{price} > 0 and not isnan({price}) and {price} < double('inf')")
    newest = F.first(price).over(Window.partitionBy(*key).orderBy(F.desc(order)))
    marked = valid.withColumn("newest", newest)
    got = marked.groupBy(*key).agg(F.first("newest").alias("price"), F.max_by(price, F.when(c(price) != c("newest"), c(order))).alias("before"))
    delta = c("price") - c("before")
    return got.select(*key, "price", "before", delta.alias("delta"), (delta / c("before") * 100).alias("pct"))
