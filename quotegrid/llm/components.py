"""Connected components over an edge table that grows with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, hot_keys, shared_dir, written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """For edges (a long, b long), the nodes that an edge touches: node, label
    (the smallest node of its component).

    Each round, a node takes the smallest label around it, and then the label of
    its label, or the smallest that any node of that label has found: so whole
    trees are hooked at once, and the rounds grow with the logarithm of a chain's
    length in whatever order its nodes are numbered. Labels meet by sums that
    start on the map side, and the edges of a node with very many (a star's
    centre) are dealt over slots, each with a copy of its label. Every round is
    written to the shared folder, and the round before it is deleted. Edges to
    itself and repeated edges do no harm.
    """
    spark = edges.sparkSession
    where = shared_dir(spark)
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{where}/edges")
    hot = hot_keys(both, ["b"])
    if hot is not None:
        both = both.join(F.broadcast(hot), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("slots")), F.lit(0).cast("long")).alias("slot"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), f"{where}/0")
    for i in range(1, MOST_ROUNDS + 1):
        around = labels.select(F.col("node").alias("b"), "label")
        if hot is not None:
            around = around.join(F.broadcast(hot), "b", "left").select("b", "label", F.explode(F.expr("sequence(0L, coalesce(slots, 1L) - 1)")).alias("slot"))
        near = both.join(around, ["b"] if hot is None else ["b", "slot"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("up"))  # a root leads nowhere: what most nodes share has no row here
        up = up.union(hooked.where("label < was").select("was", "label")).groupBy("label").agg(F.min("up").alias("up"))
        new = written(hooked.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), f"{where}/{i}")
        delete(spark, f"{where}/{i - 1}")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"components: not settled after {MOST_ROUNDS} rounds")
