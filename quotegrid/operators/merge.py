"""Joining offers across sources, full outer merges, and set operations that keep an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def unify(offers: DataFrame, show: Sequence[str] = ("show_id",)) -> DataFrame:
    """One row for each performance of a show from its sources' offers (of one
    source's several, the last by ``raw_ord`` counts): least price, largest (of
    upper prices if there is any, even below a least one), first currency,
    whether any is available (null if nobody says), and how many sources."""
    key = [*show, "date", "time"]
    rest = ["price_from", "price_to", "currency", "book_url", "available"]
    each = offers.groupBy(*key, "source", "source_ord").agg(F.max_by(F.struct(*rest), "raw_ord").alias("x")).select(*key, "source", "source_ord", "x.*")
    return each.groupBy(*key).agg(
        F.min("price_from").alias("min_price"),
        F.coalesce(F.max("price_to"), F.max("price_from")).alias("max_price"),
        F.min_by(F.nullif("currency", F.lit("")), F.when(F.nullif("currency", F.lit("")).isNotNull(), c("source_ord"))).alias("currency"),
        F.bool_or("available").alias("any_available"),
        F.count("*").alias("source_count"),
    )


def fill_from(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Full outer merge: the left rows, with what they lack filled from the right
    ones, and the right rows that have no partner; ``side`` says which they are."""
    r = right.select(*keys, *[c(x).alias(f"__{x}") for x in fill], F.lit(True).alias("__r"))
    joined = left.withColumn("__l", F.lit(True)).join(r, list(keys), "full")
    side = F.when(c("__l") & c("__r"), "both").when(c("__l"), "left").otherwise("right")
    return joined.withColumns({**{x: F.coalesce(c(x), c(f"__{x}")) for x in fill}, "side": side}).drop("__l", "__r", *[f"__{x}" for x in fill])


def prefer(sides: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which the whole row of the first side that has a key wins; rows without a key all stay."""
    out = None
    for i, df in enumerate(sides):
        own = df.withColumn("__side", F.lit(i))
        out = own if out is None else out.unionByName(own)
    known = F.lit(True)
    for k in keys:
        known = known & c(k).isNotNull()
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__side"))
    return out.where(known).withColumn("__n", first).where("__n = 1").drop("__n").unionByName(out.where(~known)).withColumn("side", c("__side")).drop("__side")


def union_with_membership(slices: DataFrame, key: str, order: Sequence[str] = ("slice_ord", "pos")) -> DataFrame:
    """Listings cut into slices as one: the first occurrence of each key, and the sorted names of all slices that have it."""
    rest = [x for x in slices.columns if x != key]
    got = slices.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"), F.array_join(F.array_sort(F.collect_set("slice")), ",").alias("appears_in"))
    return got.select(key, *[f"x.{r}" for r in rest if r != "slice"], "appears_in")


def patch_urls(perfs: DataFrame, ids: DataFrame, path: str = "/shows/seats/") -> DataFrame:
    """Addresses that end in the placeholder 0 get the performance's number, where it is known and the address holds a path."""
    joined = perfs.join(ids.select("date", "time", "perf_id"), ["date", "time"], "left")
    patched = F.when(c("perf_id").isNotNull() & c("book_url").contains(path) & F.endswith("book_url", F.lit("/0")), F.concat(F.regexp_replace("book_url", "0$", ""), c("perf_id").cast("string"))).otherwise(c("book_url"))
    return joined.withColumn("book_url", patched).drop("perf_id")


def deals_by_date(deals: DataFrame, tags: DataFrame, perfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deals through their tag's date to the performances of that date, as an
    array in the order of time; and the deals without any performance."""
    dated = deals.join(tags, "tag")
    found = dated.join(perfs, ["show_id", "date"], "left")
    out = found.groupBy("show_id", "tag", "date").agg(F.array_sort(F.collect_list(F.when(c("time").isNotNull(), F.struct("time", "price")))).alias("perfs"))
    return out, dated.join(perfs.select("show_id", "date").distinct(), ["show_id", "date"], "left_anti")


def backfill(df: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Nulls of a column from another table by key."""
    return df.join(other.select(key, c(column).alias("__v")), key, "left").withColumn(column, F.coalesce(c(column), c("__v"))).drop("__v")


def vanished(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that were there and aren't now."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def churn(old: DataFrame, new: DataFrame, key: str, alarm: float = 0.30) -> DataFrame:
    """One row: keys before, keys gone, their share, and whether that is alarming."""
    a, b = old.agg(F.countDistinct(key).alias("before")), vanished(old, new, key).agg(F.count("*").alias("gone"))
    share = F.when(c("before") > 0, c("gone") / c("before")).otherwise(0.0)
    return a.join(F.broadcast(b)).select("before", "gone", share.alias("share"), (share > alarm).alias("alarming"))  # single rows


def zipped(first: Column, second: Column) -> Column:
    """Two arrays place by place; the shorter one is filled with nulls."""
    return F.arrays_zip(first.alias("first"), second.alias("second"))
