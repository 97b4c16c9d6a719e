"""Joins on keys that a large part of the rows may share, and components of graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.session import stage

c = F.col
#: A key is hot from so many rows on; of more hot keys than that, the hottest count (no other has more than one part in so many of all rows).
HOT_ROWS, MOST_HOT_KEYS = 2048, 100_000
MOST_ROUNDS = 60


def hot_keys(df: DataFrame, keys: Sequence[str], at: int = HOT_ROWS) -> DataFrame | None:
    """The keys of ``df`` (cheap to read again) with more than ``at`` rows, how many
    (``n``), and over how many ``slots`` each is to be dealt: MOST_HOT_KEYS rows at
    most, which may be broadcast; None without any."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where(c("n") > at).withColumn("slots", F.ceil(c("n") / at).cast("long"))
    hot = counts.orderBy(F.desc("n")).limit(MOST_HOT_KEYS).toArrow()
    return df.sparkSession.createDataFrame(hot, counts.schema) if hot.num_rows else None


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: int = HOT_ROWS) -> DataFrame:
    """Inner join of two tables that may both have many rows for one key: those of
    ``left`` (cheap to read again) are dealt over slots by their hash, and each slot
    has its copy of the ``right`` rows, so no task has more than its share of the pairs."""
    hot = hot_keys(left, keys, at)
    if hot is None:
        return left.join(right, list(keys))
    hot = F.broadcast(hot.drop("n"))
    dealt = left.join(hot, list(keys), "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64(*left.columns), c("slots")), F.lit(0).cast("long"))).drop("slots")
    copies = right.join(hot, list(keys), "left").withColumn("slot", F.explode(F.expr("sequence(0L, coalesce(slots, 1L) - 1)"))).drop("slots")
    return dealt.join(copies, [*keys, "slot"]).drop("slot")


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b), node and label, the smallest node of its component.

    Each round a node takes the least label around it, and then its label's label,
    so chains shorten by half. Labels meet by sums that start on the map side;
    every round is a stage of its own.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(c("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    for _ in range(MOST_ROUNDS):
        around = labels.select(c("node").alias("b"), "label")
        near = both.join(around, "b").groupBy(c("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", c("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.where("node <> label").select(c("node").alias("label"), c("label").alias("up"))
        new = hooked.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        moved = Observation()
        labels = stage(new.observe(moved, F.count_if(c("label") < c("was")).alias("n")).select("node", "label"))
        if not moved.get["n"]:
            return labels
    raise RuntimeError(f"components: not settled after {MOST_ROUNDS} rounds")


def first_shared(a: Column, b: Column) -> Column:
    """The first member of an array that the other has too; null without one."""
    return F.get(F.array_intersect(a, b), F.lit(0))
