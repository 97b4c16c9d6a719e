"""Exact distinct counts from bitmaps that add up.

``bitmaps`` makes, in one pass over the rows, one bitmap of ids for each group and
each range of 32,768 ids; coarser groups come from them by or, never from the rows
again. They can be stored and later days put beside them.

Ids are whole numbers; a null id counts nowhere, but its group is there with 0.
Repeated rows count once. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .offers import PERF

c = F.col
#: Sellers are a fixed list; their numbers are bits of one long.
MOST_SELLERS = 62


def bitmaps(rows: DataFrame, dims: Sequence[str], id_col: str) -> DataFrame:
    """dims, bucket, bits: the ids of each group. Summed on the map side first, so a
    group that holds most rows sends a few bitmaps for each task."""
    part = F.bitmap_bucket_number(c(id_col)).alias("bucket")
    return rows.groupBy(*dims, part).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c(id_col))).alias("bits"))


def merged(maps: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups, or of several tables put under each other."""
    return maps.groupBy(*dims, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_ids(maps: DataFrame, dims: Sequence[str], out: str = "n") -> DataFrame:
    """The number of distinct ids of each group."""
    return merged(maps, dims).groupBy(*dims).agg(F.sum(F.bitmap_count("bits")).alias(out))


def cube(maps: DataFrame, dims: Sequence[str], out: str = "n") -> DataFrame:
    """Distinct ids of each combination of dims, of each part of them, and of all;
    ``level`` has a bit for each dim that was summed over (the first is the highest),
    which tells a null dim from a dim that was summed over. It is the bitmaps that are copied for
    each combination, not the rows."""
    sets = [[*(d for i, d in enumerate(dims) if at >> i & 1), "bucket"] for at in range(1 << len(dims))]
    level = (F.grouping_id() / 2).cast("long").alias("level")  # its lowest bit is the bucket's, which is in every set
    each = maps.groupingSets([[c(x) for x in s] for s in sets], *dims, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("_n"), level)
    return each.groupBy(*dims, "level").agg(F.sum("_n").alias(out))


def show_facts(offers: DataFrame) -> DataFrame:
    """For each show, facts that add up over shows: performances, offers, its
    sellers' numbers as bits, and its least price. A performance's offers meet first,
    so that performances are counted and not told apart a second time."""
    bit = F.when((c("source_ord") >= 0) & (c("source_ord") <= MOST_SELLERS), F.expr("shiftleft(1L, source_ord)"))
    perf = offers.groupBy(*PERF).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"), F.min("price_from").alias("low"))
    return perf.groupBy("show_id").agg(F.count("*").alias("perf_count"), F.sum("n").alias("offer_count"), F.bit_or("bits").alias("sellers"), F.min("low").alias("min_price"))
