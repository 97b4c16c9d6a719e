"""Fetch attempts as data: what became of each fetch, and when pages came to rest.

Answers are rows (keys, attempt, at, status): attempt counts from 1, status is the
HTTP status, null where nothing came back. All is made of minima and maxima, so
neither the order nor the repetition of rows matters, sums start on the map side,
and a key with very many answers is one row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prices

c = F.col


@dataclass(frozen=True)
class Policy:
    """Attempts at most, seconds before the second one (doubled for each further
    one), seconds from the first answer within which one must succeed, and the
    statuses after which it is worth asking again (no answer is one too)."""

    attempts: int = 3
    backoff: int = 2
    deadline: int = 60
    again: tuple[int, ...] = (429, 500, 502, 503, 504)


def kind(status: Column, policy: Policy = Policy()) -> Column:
    """ok, again or refused."""
    return F.when(status.between(200, 299), "ok").when(status.isNull() | status.isin(*policy.again), "again").otherwise("refused")


def reason(end: Column, status: Column, attempt: Column) -> Column:
    """What a failure is called; null for what succeeded."""
    said = F.when(status.isNull(), F.lit("no answer")).otherwise(F.concat(F.lit("HTTP "), status.cast("string")))
    return F.when(end == "refused", said).when(end == "exhausted", F.concat(said, F.lit(" after "), attempt.cast("string"), F.lit(" attempts"))).when(end == "deadline", F.concat(F.lit("deadline, last "), said))


def backoff(attempt: Column, policy: Policy = Policy()) -> Column:
    """Seconds to wait after an attempt. The doubling ends after 30 steps."""
    return F.lit(policy.backoff) * F.pow(F.lit(2.0), F.least(attempt, F.lit(31)) - 1).cast("long")


def outcomes(answers: DataFrame, now: Column, keys: Sequence[str] = ("key",), policy: Policy = Policy()) -> DataFrame:
    """For each key: outcome (ok, refused, exhausted, deadline, pending), attempt and
    status of the answer that decided it (else of the last one), reason, and
    next_at, when a pending key may be asked again.

    The first answer that is ok, refused or the last allowed decides, if it came by
    the deadline; answers after it change nothing. Equal times go by attempt, then
    by status with none first. Rows without a time or an attempt are left out, so a
    key with none else is missing (``missing`` in the catalog names it).
    """
    rows = answers.where("at is not null and attempt is not null").withColumn("_kind", kind(c("status"), policy))
    rows = rows.withColumn("_end", F.when(c("_kind") != "again", c("_kind")).when(c("attempt") >= policy.attempts, "exhausted"))
    one = F.struct("at", "attempt", "status", "_end")
    sums = rows.groupBy(*keys).agg(F.min("at").alias("_start"), F.min(F.when(c("_end").isNotNull(), one)).alias("_first"), F.max(one).alias("_last"))
    by = c("_start") + F.make_dt_interval(secs=F.lit(policy.deadline))
    decided = c("_first").isNotNull() & (c("_first.at") <= by)
    x = F.when(decided, c("_first")).otherwise(c("_last"))
    out = sums.withColumn("_x", x).withColumn("outcome", F.when(decided, c("_first._end")).when(now > by, "deadline").otherwise("pending"))
    wait = c("_x.at") + F.make_dt_interval(secs=backoff(c("_x.attempt"), policy))
    return out.select(
        *keys, "outcome", c("_x.attempt").alias("attempt"), c("_x.status").alias("status"), reason(c("outcome"), c("_x.status"), c("_x.attempt")).alias("reason"),
        F.when(c("outcome") == "pending", wait).alias("next_at"),
    )


def settled(polls: DataFrame, keys: Sequence[str] = ("key",), same: int = 2, bounds: tuple[float, float] = prices.VISIBLE_BOUNDS) -> DataFrame:
    """Pages that fill in while they are polled (keys, poll, text): the poll at which
    the visible prices had stayed the same, and not empty, for ``same`` polls after
    they were first seen; else the last poll.

    keys, poll, stable, low, high, n_prices, note. Polls stand in a key's order by
    window, so a key's polls are sorted, not held; of polls with one number the
    first by text counts. Rows without a number are left out.
    """
    found = polls.where("poll is not null").groupBy(*keys, "poll").agg(F.min_by("text", F.coalesce("text", F.lit(""))).alias("text"))
    seen = found.select(*keys, "poll", prices.all_pound_prices(c("text"), bounds).alias("found"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(prices.POUND_PRICE), 1)).alias("raw"))
    order = Window.partitionBy(*keys).orderBy("poll")
    moved = seen.withColumn("new", F.coalesce(c("found") != F.lag("found").over(order), F.lit(True)).cast("int"))
    runs = moved.withColumn("run", F.sum("new").over(order)).withColumn("stay", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("poll")) - 1)
    one = F.struct("poll", "found", "raw")
    ends = runs.groupBy(*keys).agg(F.min(F.when((c("stay") >= same) & (F.size("found") > 0), one)).alias("rest"), F.max(one).alias("last"))
    x = ends.withColumn("x", F.coalesce("rest", "last"))
    none = F.concat(F.lit("no prices in plausible range; saw "), c("x.raw").cast("string"), F.lit(" raw"))
    return x.select(*keys, c("x.poll").alias("poll"), c("rest").isNotNull().alias("stable"), F.array_min("x.found").alias("low"), F.array_max("x.found").alias("high"), F.size("x.found").alias("n_prices"), F.when(F.size("x.found") > 0, "chips").otherwise(none).alias("note"))
