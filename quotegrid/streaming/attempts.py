"""Fetch attempts over a stream: requests to ask again, and outcomes.

A key's state is three small rows (first answer's time, the earliest deciding
answer, the last answer), never its answers. Timers of event time do the rest: at
the end of a back-off a row ``again`` asks for the next attempt, and once the
watermark has passed the deadline a row with the outcome ends the key. Outcomes
wait for the deadline, so that they are the same in whatever order answers came
(late by less than the watermark's delay); they are those of ``operators.attempts``.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import attempts as A

OUT = "key string, outcome string, attempt int, status int, due timestamp"
STATE = "start long, first_at long, first_attempt int, first_status int, first_end string, last_at long, last_attempt int, last_status int, last_end string"


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _order(x: tuple) -> tuple:
    """As structs are ordered: null before all others."""
    return tuple((v is not None, v if v is not None else 0) for v in x[:3]) + ((x[3] is not None, x[3] or ""),)


class Attempts(StatefulProcessor):
    def __init__(self, policy: A.Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int, tuple | None, tuple] | None:
        if not self.known.exists():
            return None
        s = self.known.get()
        return s[0], (s[1:5] if s[1] is not None else None), s[5:9]

    def _by(self, start: int) -> int:
        return start + self.policy.deadline * 1_000_000

    def _due(self, last: tuple) -> int:
        return last[0] + self.policy.backoff * 2 ** (min(last[1], 31) - 1) * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self._read()
        start, first, last = had or (None, None, None)
        for batch in rows:
            for r in batch.itertuples(index=False):
                one = (_micros(r.at), int(r.attempt), None if pd.isna(r.status) else int(r.status), None if pd.isna(r.end) else r.end)
                start = one[0] if start is None else min(start, one[0])
                if one[3] is not None and (first is None or _order(one) < _order(first)):
                    first = one
                if last is None or _order(one) > _order(last):
                    last = one
        self.known.update((start, *(first or (None,) * 4), *last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # timers are in milliseconds and go off when the watermark has passed them
        self.handle.registerTimer(self._by(start) // 1000 + 1)
        if first is None and self._due(last) <= self._by(start):
            self.handle.registerTimer(self._due(last) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had = self._read()
        if had is None:
            return
        start, first, last = had
        if expiredTimerInfo.getExpiryTimeInMs() <= self._by(start) // 1000:
            yield self._row(key, "again", last[1] + 1, None, self._due(last))
            return
        decided = first is not None and first[0] <= self._by(start)
        end = first if decided else last
        yield self._row(key, end[3] if decided else "deadline", end[1], end[2], None)
        self.known.clear()

    def _row(self, key, outcome: str, attempt: int, status: int | None, due: int | None) -> pd.DataFrame:
        at = None if due is None else datetime.datetime.fromtimestamp(due / 1_000_000, datetime.timezone.utc).replace(tzinfo=None)
        row = pd.DataFrame({"key": [key[0]], "outcome": [outcome], "attempt": [attempt], "status": [status], "due": pd.to_datetime([at])})
        return row.astype({"attempt": "Int32", "status": "Int32"})


def follow(answers: DataFrame, late: str = "10 minutes", policy: A.Policy = A.Policy()) -> DataFrame:
    """A streaming table (key, outcome, attempt, status, due) from a streaming table
    of answers (key, attempt, at, status). Needs the RocksDB state store."""
    kind = A.kind(F.col("status"), policy)
    end = F.when(kind != "again", kind).when(F.col("attempt") >= policy.attempts, "exhausted")
    rows = answers.where("at is not null and attempt is not null").select(F.col("key").cast("string").alias("key"), F.col("attempt").cast("int").alias("attempt"), "at", F.col("status").cast("int").alias("status"), end.alias("end"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Attempts(policy), OUT, "Append", "EventTime")
