"""Data-quality checks. They say what is wrong and stop nothing."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def coverage_level(found: Column, expected: Column, warn: float = 0.90, bad: float = 0.80) -> Column:
    """``critical`` for no rows, ``error`` and ``warning`` below shares of what was expected, else ``ok``."""
    return F.when(found == 0, "critical").when(found < expected * bad, "error").when(found < expected * warn, "warning").otherwise("ok")


def missing_shares(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """For each column with a limit: the share of rows that lack it, and whether that is above the limit. One pass over the table."""
    gone = {k: F.avg(F.when(c(k).isNull() | (c(k).cast("string") == ""), 1.0).otherwise(0.0)) for k in limits}
    one = df.agg(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in gone.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c(k).alias("share"), F.lit(float(m)).alias("most")) for k, m in limits.items()]))
    return one.select(rows.alias("x")).select("x.field", "x.share", (c("x.share") > c("x.most")).alias("exceeded"))


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """For each rule, how many rows break it; a rule whose inputs are null isn't broken. One pass over the table."""
    one = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("n")) for k in rules])).alias("x")).select("x.rule", "x.n")


def offer_rules(as_of: datetime.date, low: float = 0.0, high: float = 10_000.0) -> dict[str, Column]:
    """What is wrong with an offer: prices out of range or the wrong way round, odd years, no address, no seller."""
    return {
        "price_not_positive": c("price_from") <= low,
        "price_too_high": c("price_from") >= high,
        "min_above_max": c("price_from") > c("price_to"),
        "year_out_of_range": (F.year("date") < 2020) | (F.year("date") > as_of.year + 5),
        "no_book_url": c("book_url").isNull() | (c("book_url") == ""),
        "no_source": c("source").isNull() | (c("source") == ""),
    }


def show_rules(origin: str) -> dict[str, Column]:
    """What is wrong with a show: no title or venue, a rating beyond 0 to 5, an
    address elsewhere, a stock number that isn't its id, a price that is neither 0 nor 1 to 500."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return {
        "empty_name": blank(c("title")),
        "empty_venue": blank(c("venue")),
        "rating_out_of_range": ~c("rating").between(0, 5),
        "foreign_url": ~F.startswith(c("url"), F.lit(origin)),
        "sku_differs": c("sku") != c("id").cast("string"),
        "odd_price": ~((c("price") == 0) | c("price").between(1, 500)),
    }


def url_mismatch(df: DataFrame, canonical: str, url: str, most: float = 0.10) -> DataFrame:
    """The share of rows whose canonical address isn't the row's, slashes at the end aside."""
    differs = F.rtrim(c(canonical), F.lit("/")) != F.rtrim(c(url), F.lit("/"))
    one = df.where(c(canonical).isNotNull()).agg(F.count("*").alias("n"), F.count_if(differs).alias("mismatches"))
    return one.withColumn("exceeded", F.coalesce(c("mismatches") > c("n") * most, F.lit(False)))


def histogram(df: DataFrame, what: Column, name: str = "kind") -> DataFrame:
    return df.groupBy(what.alias(name)).agg(F.count("*").alias("n"))


def samples(df: DataFrame, by: str, value: str, k: int = 3) -> DataFrame:
    """How many rows each kind has, and its k smallest values. The values are kept k at a time on the way."""
    from pyspark.sql import Window

    few = df.select(by, value).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(value))).where(c("__n") <= k).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("samples"))
    return df.groupBy(by).agg(F.count("*").alias("n")).join(few, by, "left")


def compare_runs(old: DataFrame, new: DataFrame, show: str, shows_drop: float = 0.20, perfs_drop: float = 0.50, churn_share: float = 0.30) -> DataFrame:
    """One row: shows and performances of two runs, the vanished shows, and which drops are alarming."""
    a = old.agg(F.countDistinct(show).alias("old_shows"), F.count("*").alias("old_perfs"))
    b = new.agg(F.countDistinct(show).alias("new_shows"), F.count("*").alias("new_perfs"))
    gone = old.select(show).distinct().join(new.select(show), show, "left_anti").agg(F.count("*").alias("gone"))
    one = a.join(F.broadcast(b)).join(F.broadcast(gone))  # single rows
    return one.withColumns({"shows_alarm": c("new_shows") < c("old_shows") * (1 - shows_drop), "perfs_alarm": c("new_perfs") < c("old_perfs") * (1 - perfs_drop), "churn_alarm": c("gone") > c("old_shows") * churn_share})


def run_status(attempts: Column, ok: Column, network_failures: Column) -> Column:
    """``drift`` if all attempts failed, unless all by the network (``blocked``); ``idle`` without attempts."""
    return F.when(attempts == 0, "idle").when(ok > 0, "ok").when(network_failures == attempts, "blocked").otherwise("drift")


def differing_share(df: DataFrame, a: str, b: str, most: float = 0.05) -> DataFrame:
    """One row: rows that have both of two ids, those whose ids differ, and whether they are too many."""
    one = df.where(c(a).isNotNull() & c(b).isNotNull()).agg(F.count("*").alias("n"), F.count_if(c(a).cast("string") != c(b).cast("string")).alias("differing"))
    return one.withColumn("exceeded", F.coalesce(c("differing") > c("n") * most, F.lit(False)))


def agreement(df: DataFrame, mark: Column) -> DataFrame:
    """One row: how often a mark is true, false and unknown."""
    return df.agg(F.count_if(mark).alias("agree"), F.count_if(~mark).alias("differ"), F.count_if(mark.isNull()).alias("unknown"))
