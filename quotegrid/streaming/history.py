"""Price history over a stream of snapshots.

``start`` keeps, for each performance, the last payload in the stream's state
and emits a row when it changes: the streaming form of append-on-change. A
replayed run (the same stamp) emits nothing. State of a performance ends once
the watermark has passed its date, as pruning would.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import history as H
from ..sources import catalog

OUT = "show_id string, date string, time string, t string, seen_at timestamp, min double, max double, any_available boolean, seq long"
STATE = "t string, min double, max double, any_available boolean, seq long"


def _same(a: float | None, b: float | None) -> bool:
    return (pd.isna(a) and pd.isna(b)) or a == b


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get if state.exists else None
    rows = []
    for batch in batches:
        for r in batch.sort_values(["seen_at", "t"]).itertuples(index=False):
            if last is not None and (last[0] == r.t or all(_same(x, y) for x, y in zip(last[1:4], (r.min, r.max, r.any_available)))):
                continue
            seq = (last[4] if last is not None else 0) + 1
            last = (r.t, None if pd.isna(r.min) else float(r.min), None if pd.isna(r.max) else float(r.max), None if pd.isna(r.any_available) else bool(r.any_available), seq)
            rows.append((*key, r.t, r.seen_at, *last[1:4], seq))
    if last is not None:
        state.update(last)
        end = datetime.datetime.combine(datetime.date.fromisoformat(key[1]), datetime.time(), datetime.timezone.utc) + datetime.timedelta(days=1)
        limit = int(end.timestamp() * 1000)
        if limit > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(limit)
    if rows:
        yield pd.DataFrame(rows, columns=["show_id", "date", "time", "t", "seen_at", "min", "max", "any_available", "seq"])


def changes(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """A streaming table of history rows from a streaming table of snapshots
    (show_id, date, time, t, seen_at, min, max, any_available)."""
    return (
        snapshots.withWatermark("seen_at", late)
        .groupBy("show_id", "date", "time")
        .applyInPandasWithState(_changes, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def floors(offers: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """A streaming table of floors, offers and shows for each window of event
    time. A window's state holds its shows' ids, so that they are counted exactly."""
    valid = offers.where("price_from > 0 and not isnan(price_from) and coalesce(available, true)")
    return valid.withWatermark("seen_at", late).groupBy(F.window("seen_at", window)).agg(F.min("price_from").alias("floor"), F.count("*").alias("n"), F.size(F.collect_set("show_id")).alias("shows")).select(F.col("window.start").alias("start"), "floor", "n", "shows")


WHOLE = "-whole"


def _runs(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """The runs that make up the history up to an epoch: the last whole one and those after it."""
    runs = [r for r in catalog.run_ids(spark, path) if before is None or int(r.removesuffix(WHOLE)) < before]
    start = max((i for i, r in enumerate(runs) if r.endswith(WHOLE)), default=0)
    return runs[start:]


def read_history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The history that a stream has written, up to an epoch; empty if there is no run yet."""
    runs = _runs(spark, path, before)
    if not runs:
        return spark.createDataFrame([], H.SCHEMA)
    return spark.read.schema(H.SCHEMA).parquet(*[f"{path}/run_id={r}" for r in runs])


def append_batches(snapshots: DataFrame, path: str, checkpoint: str, live: DataFrame | None = None, as_of: datetime.date | None = None, compact_every: int = 500) -> StreamingQuery:
    """Each micro-batch through the batch operators onto a history: a run holds
    the rows that its batch appended. A batch that comes twice writes its run
    again, so nothing is doubled. A read that fails fails the batch, and the
    stream stops with what it has written so far.

    Every ``compact_every`` epochs the run is the whole history, pruned if
    ``live`` and ``as_of`` are given; the runs before it are dropped when the
    epoch after it starts, so a compaction that is repeated finds them still.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        catalog.drop_runs(spark, path, [r for r in catalog.run_ids(spark, path) if r < min(_runs(spark, path, epoch), default="")])
        before = read_history(spark, path, epoch)
        known = before.join(batch.select(*H.KEY).distinct(), H.KEY, "left_semi")
        out = H.decide(known, batch).where("fate = 'append'").select(*before.columns)
        whole = epoch > 0 and epoch % compact_every == 0
        out = before.unionByName(out) if whole else out
        if live is not None and as_of is not None:
            out = H.prune(out, live, as_of)
        catalog.write_run(out, path, f"{epoch:010d}{WHOLE if whole else ''}", keep=None)

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
