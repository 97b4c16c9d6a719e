"""Sellers, venues, shows: leaderboards, roll-ups, filters and search."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prices, text
from . import counts
from .offers import PERF, _future, between, first_rows, lit_date, ranked

KNOWN = "__unknown"


def widest_spreads(offers: DataFrame, as_of: datetime.date, days: int = 30, least: float = 5.0, k: int = 8) -> DataFrame:
    """Performances with two valid prices or more (whatever the availability)
    that lie apart by ``least`` at least; the widest of each show, the first k of all."""
    ok = between(offers, as_of, days).where(prices.valid_price(F.col("price_from")))
    perf = ok.groupBy(*PERF).agg(
        F.min_by(F.struct("source", "price_from"), F.struct("price_from", "source_ord")).alias("cheap"), F.max_by(F.struct("source", "price_from"), F.struct("price_from", "source_ord")).alias("dear"), F.count("*").alias("sellers")
    ).where("sellers >= 2").withColumn("spread", F.col("dear.price_from") - F.col("cheap.price_from")).where(F.col("spread") >= least)
    best = perf.groupBy("show_id", "show_ord").agg(F.min_by(F.struct("date", "time", "cheap", "dear", "sellers", "spread"), F.struct(-F.col("spread"), "date", "time")).alias("x")).select("show_id", "show_ord", "x.*")
    pct = prices.js_round(F.col("spread") / F.col("dear.price_from") * 100)
    return first_rows(best, [F.desc("spread"), F.col("show_ord")], k).select("rank", "show_id", "date", "time", F.col("cheap.source").alias("cheap_seller"), F.col("cheap.price_from").alias("cheap_price"), F.col("dear.source").alias("dear_seller"), F.col("dear.price_from").alias("dear_price"), "spread", pct.alias("pct"), "sellers")


def seller_wins(offers: DataFrame, k: int = 20) -> DataFrame:
    """For each performance (past ones too, whatever the availability) the single
    cheapest seller; wins by seller and show, the first k shows of each seller."""
    ok = offers.where(prices.valid_price(F.col("price_from"))).groupBy(*PERF).agg(F.min_by("source", F.struct("price_from", "source_ord")).alias("seller"))
    wins = ok.groupBy("seller", "show_id", "show_ord").agg(F.count("*").alias("wins"))
    rank = F.row_number().over(Window.partitionBy("seller").orderBy(F.desc("wins"), "show_ord"))
    return wins.withColumn("rank", rank).where(F.col("rank") <= k).select("seller", "rank", "show_id", "wins")


def seller_shows(offers: DataFrame) -> DataFrame:
    """For each seller, its shows, offers, and shows with a valid price."""
    valid = prices.valid_price(F.col("price_from"))
    return offers.groupBy("source").agg(F.countDistinct("show_id").alias("show_count"), F.count("*").alias("offer_count"), F.countDistinct(F.when(valid, F.col("show_id"))).alias("priced_show_count"))


def scoreboard(offers: DataFrame) -> DataFrame:
    """For each show and seller: performances where it is cheapest (all of equal
    ones count), its best price, and its performances with a valid price."""
    ok = offers.where(prices.valid_price(F.col("price_from")))
    least = F.min("price_from").over(Window.partitionBy(*PERF))
    return ok.withColumn("least", least).groupBy("show_id", "source").agg(F.count_if(F.col("price_from") == F.col("least")).alias("cheapest_count"), F.min("price_from").alias("best_price"), F.count("*").alias("total_count"))


def price_axis(offers: DataFrame) -> DataFrame:
    """For each show, the ends of its price axis over all sellers, 0 without a valid price."""
    valid = F.when(prices.valid_price(F.col("price_from")), F.col("price_from"))
    return offers.groupBy("show_id").agg(F.coalesce(F.min(valid), F.lit(0.0)).alias("axis_min"), F.coalesce(F.max(valid), F.lit(0.0)).alias("axis_max"))


def equal_prices(offers: DataFrame, as_of: datetime.date) -> DataFrame:
    """For each performance of a day, its sellers grouped by equal price, and where the price stands between cheapest and dearest (in percent; 50 if they are one)."""
    ok = offers.where((F.col("date") == lit_date(as_of)) & prices.valid_price(F.col("price_from")))
    groups = ok.groupBy(*PERF, "price_from").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "source"))), lambda x: x["source"]), ",").alias("sellers"))
    perf = Window.partitionBy(*PERF)
    low, high = F.min("price_from").over(perf), F.max("price_from").over(perf)
    at = F.when(high > low, (F.col("price_from") - low) / (high - low) * 100).otherwise(50.0)
    return groups.select("show_id", "time", F.col("price_from").alias("price"), "sellers", at.alias("position"))


def seller_rows(offers: DataFrame, shows: DataFrame, as_of: datetime.date) -> DataFrame:
    """For each performance of a day, sellers by ascending price with a booking
    address: the offer's own, else one of the seller for the show, else a search page."""
    ok = offers.where((F.col("date") == lit_date(as_of)) & prices.valid_price(F.col("price_from")))
    other = offers.where("book_url is not null").groupBy("show_id", "source").agg(F.min("book_url").alias("other_url"))
    rank = F.row_number().over(Window.partitionBy("show_id", "time").orderBy("price_from", "source_ord"))
    search = F.concat(F.lit("https://search.example/?q="), F.regexp_replace("title", "[^A-Za-z0-9]+", "+"))
    return ok.join(other, ["show_id", "source"], "left").join(shows.select("show_id", "title"), "show_id").select("show_id", "time", rank.alias("rank"), "source", F.col("price_from").alias("price"), F.coalesce("book_url", "other_url", search).alias("url"))


def venues(shows: DataFrame, offers: DataFrame, eff: DataFrame, as_of: datetime.date) -> DataFrame:
    """Shows by venue key: the most frequent display name (the first of equals),
    shows, shows with a future, floor, and performances of the next seven days.
    Shows are summed alone first, so a venue with very many shows adds numbers only."""
    future = _future(offers, as_of).groupBy("show_id").agg(F.count_if(F.col("date") < lit_date(as_of + datetime.timedelta(days=7))).alias("week"))
    floor = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id").agg(F.min("price").alias("floor"))
    key = F.coalesce("venue_norm", "venue", F.lit(KNOWN))
    each = shows.join(future, "show_id", "left").join(floor, "show_id", "left").withColumn("key", key)
    names = each.where("venue is not null").groupBy("key", "venue").agg(F.count("*").alias("c"), F.min("show_ord").alias("first")).groupBy("key").agg(F.max_by("venue", F.struct("c", -F.col("first"))).alias("name"))
    sums = each.groupBy("key").agg(F.first("venue_norm").alias("venue_norm"), F.count("*").alias("show_count"), F.count("week").alias("active_count"), F.min("floor").alias("floor"), F.coalesce(F.sum("week"), F.lit(0)).alias("week_perfs"))
    named = sums.join(names, "key", "left").withColumn("display_name", F.coalesce("name", "venue_norm", F.lit("Unknown venue")))
    group = [F.when(F.col("active_count") > 0, 0).otherwise(1), -F.col("show_count")]
    return ranked(named, group, [F.col("display_name")]).select("rank", text.slug(F.col("display_name")).alias("slug"), "display_name", "show_count", "active_count", "floor", "week_perfs")


def venue_detail(shows: DataFrame, offers: DataFrame, eff: DataFrame, as_of: datetime.date, slug: str) -> DataFrame:
    """The shows of a venue that play on: floor, first and last date, length of
    the run; the cheapest first, without a floor last, then by title."""
    own = shows.where(text.slug(F.col("venue")) == slug)
    runs = _future(offers, as_of).join(own.select("show_id"), "show_id", "left_semi").groupBy("show_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("run_length"))
    floor = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id").agg(F.min("price").alias("floor"))
    return own.join(runs, "show_id").join(floor, "show_id", "left").select("show_id", "title", "floor", "first_date", "last_date", "run_length").orderBy(F.asc_nulls_last("floor"), "title")


def show_filters(shows: DataFrame, offers: DataFrame, eff: DataFrame, as_of: datetime.date, closing_days: int = 30, opening_days: int = 21, few: int = 30, gem_floor: float = 25.0, gem_sources: int = 2) -> DataFrame:
    """Five marks of each show with a future, in one pass over its performances."""
    day = lambda n: lit_date(as_of + datetime.timedelta(days=n))
    runs = _future(offers, as_of).groupBy("show_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))
    priced = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id").agg(F.min("price").alias("floor"), F.count("*").alias("priced"), F.count_if(F.col("seller_count") == 1).alias("single"))
    return runs.join(priced, "show_id", "left").join(shows.select("show_id", "source_count"), "show_id").select(
        "show_id",
        (F.col("last") <= day(closing_days)).alias("closing_soon"),
        ((F.col("first") > lit_date(as_of)) & (F.col("first") <= day(opening_days))).alias("opening_soon"),
        (F.col("n") < few).alias("limited"),
        F.coalesce((F.col("priced") > 0) & (F.col("single") == F.col("priced")), F.lit(False)).alias("exclusive"),
        F.coalesce((F.col("floor") <= gem_floor) & (F.coalesce("source_count", F.lit(0)) <= gem_sources), F.lit(False)).alias("hidden_gem"),
    )


def coverage(shows: DataFrame) -> DataFrame:
    """How many shows have how many distinct sellers, with shares of all and of those with three or more.
    The totals go over a row for each number of sellers, so the shows are read once."""
    rows = shows.groupBy(F.col("source_count").alias("sellers")).agg(F.count("*").alias("show_count"))
    every = Window.partitionBy()
    rows = rows.withColumns({"total": F.sum("show_count").over(every), "well_covered": F.coalesce(F.sum(F.when(F.col("sellers") >= 3, F.col("show_count"))).over(every), F.lit(0))})
    return rows.select("sellers", "show_count", "total", "well_covered", prices.js_round(F.col("show_count") / F.col("total") * 100).alias("pct"))


def methodology(shows: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: shows, performances, offers, sellers, shows whose price isn't known.
    ``shows`` (show_id) tells which shows count as such; prices come from the offers, which are read once."""
    facts = counts.show_facts(offers).join(shows.select("show_id").distinct().withColumn("listed", F.lit(1)), "show_id", "left")
    listed = F.col("listed").isNotNull()
    return facts.agg(
        F.count_if(listed).alias("show_count"), F.count_if(listed & ~prices.valid_price(F.col("min_price"))).alias("price_tbc_count"),
        F.coalesce(F.sum("perf_count"), F.lit(0)).alias("perf_count"), F.coalesce(F.sum("offer_count"), F.lit(0)).alias("offer_count"), F.coalesce(F.bit_count(F.bit_or("sellers")), F.lit(0)).cast("long").alias("seller_count"),
    )


def search(shows: DataFrame, filters: DataFrame, eff: DataFrame, as_of: datetime.date, words: str, mark: str | None = None, order: str = "price") -> DataFrame:
    """Shows with a future whose title or venue holds the words, in either case,
    and that have a mark; by title, venue or floor (none last)."""
    floor = eff.where(F.col("date") >= lit_date(as_of)).groupBy("show_id").agg(F.min("price").alias("floor"))
    w = words.strip().lower()
    held = F.lower(F.coalesce("title", F.lit(""))).contains(w) | F.lower(F.coalesce("venue", F.lit(""))).contains(w)
    out = shows.where(held).join(filters.where(F.col(mark)) if mark else filters, "show_id", "left_semi").join(floor, "show_id", "left").select("show_id", "title", "venue", "floor")
    by = {"title": ["title"], "venue": ["venue", "title"], "price": ["floor_is_null", "floor", "title"]}[order]
    return out.withColumn("floor_is_null", F.col("floor").isNull()).orderBy(*by, "show_id").drop("floor_is_null")
