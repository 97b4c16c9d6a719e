"""A search index that follows a stream of changes.

Each micro-batch is one run of the index (``operators/postings.py: add``). A batch
that comes twice writes its run again, so nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import postings as P
from ..sources.session import stage


def follow(changes: DataFrame, path: str, key: str, columns: Sequence[str], checkpoint: str, order: str = "seq", gone: str = "gone", compact_every: int = 100) -> StreamingQuery:
    """Keeps the index at ``path`` up with a streaming table of changes (``key``,
    ``columns``, ``order``, and whether the row is ``gone``; null: it isn't).

    A key has one row; of its changes in a batch the one with the largest order
    counts. Every ``compact_every`` epochs the index is written whole. Without an
    index at ``path`` the batches alone make one.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fields = [*columns, gone]
        last = stage(batch.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("x")).select(key, *[F.col("x")[f].alias(f) for f in fields]))
        left = ~F.coalesce(F.col(gone), F.lit(False))
        P.add(last.where(left), path, key, columns, removed=last.where(~left), run=f"{epoch:010d}")
        if epoch and epoch % compact_every == 0:
            P.compact(spark, path)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
