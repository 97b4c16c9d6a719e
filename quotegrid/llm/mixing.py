"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's share of the token budget is a target; equal blocks of tokens go
to sources, and then to the shards of a source, by highest quotients
(votes / 1, 3, 5, ...), in proportion to their words. Inside a shard, documents stand in a seeded order and
their words form one stream of blocks; whole rounds of the stream and then a
seeded choice of blocks fill the shard's quota, so no text is split by the
driver and no block list is ever made: the words that a document gives follow
from its place in the stream.

What the driver holds: a row for each source and for each shard
(``max_shards`` of all sources together), never a row for each document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, WORD_PATTERN, Words, small_batches, written

BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
#: Shards of all sources together: what the driver holds; beyond that shards grow.
MAX_SHARDS = 100_000
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def capped_targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above cap times its size; what
    is over goes to the others by weight, again and again."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), ties to the first. Rounding
    gives the apportionment of a house of nearly this size; seats are then added
    or taken back in the order of their quotients. ``most`` bounds each one's
    seats; what it cuts goes to the next quotients."""
    total, n = float(sum(votes)), len(votes)
    if total <= 0 or seats <= 0:
        return [0] * n
    most = list(most) if most is not None else [seats] * n
    out = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most)]
    short = seats - sum(out)
    if short > 0:
        heap = [(-votes[i] / (2 * out[i] + 1), i) for i in range(n) if out[i] < most[i] and votes[i] > 0]
        heapq.heapify(heap)
        while short and heap:
            _, i = heapq.heappop(heap)
            out[i] += 1
            short -= 1
            if out[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif short < 0:
        heap = [(votes[i] / (2 * out[i] - 1), -i) for i in range(n) if out[i]]
        heapq.heapify(heap)
        while short:
            _, i = heapq.heappop(heap)
            i = -i
            out[i] -= 1
            short += 1
            if out[i]:
                heapq.heappush(heap, (votes[i] / (2 * out[i] - 1), -i))
    return out


def _stream(slim: DataFrame, weights: Sequence[float], repeats: int, block: int, shard_words: int, max_shards: int, seed: int) -> DataFrame:
    """For (doc_id, source, size, row): source_size, target, and the place of the
    document's words in its shard's stream (stop) with what the shard takes:
    ``rounds`` times all, then ``picked`` of ``n`` blocks, from ``turn`` on."""
    spark = slim.sparkSession
    sources = sorted((tuple(r) for r in slim.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] or 0 for r in sources]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], repeats) if sources else []
    blocks = sainte_lague(targets, round(sum(targets) / block), [-(-repeats * s // block) for s in sizes])
    per_shard = max(shard_words, -(-sum(sizes) // max_shards))
    plan = spark.createDataFrame([(i, s[0], sizes[i], float(targets[i]), max(1, -(-sizes[i] // per_shard))) for i, s in enumerate(sources)], "k int, source string, source_size long, target double, shards int")
    placed = slim.join(F.broadcast(plan), slim["source"].eqNullSafe(plan["source"]), "left").drop(plan["source"])
    placed = placed.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, row, {seed}), shards) as int)"))
    words: dict[int, list[tuple[int, int]]] = {}
    for k, shard, w in sorted(tuple(r) for r in placed.groupBy("k", "shard").agg(F.sum("size")).collect()):
        words.setdefault(k, []).append((shard, w or 0))
    quotas = []
    for k, shards in words.items():
        given = sainte_lague([w for _, w in shards], blocks[k], [-(-repeats * w // block) for _, w in shards])
        for (shard, w), b in zip(shards, given):
            rounds, rest = divmod(min(b * block, repeats * w), w) if w else (0, 0)
            n = -(-w // block)
            quotas.append((k, shard, rounds, n, min(n, round(rest / block)), (seed * 2654435761 + (k * max_shards + shard) * 40503) % max(n, 1)))
    quota = spark.createDataFrame(quotas, "k int, shard int, rounds long, n long, picked long, turn long")
    order = Window.partitionBy("k", "shard").orderBy("mixed", "doc_id", "row", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("mixed", F.xxhash64("doc_id", "row", F.lit(seed + 1))).withColumn("stop", F.sum("size").over(order)).join(F.broadcast(quota), ["k", "shard"])


def mix(docs: DataFrame, size: Column | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = 17) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, taken.

    A null source is a source of its own, last in order. A null text or one
    without words has size 0 and gives 0. Rows that repeat are documents of
    their own; equal rows may swap places, which no result shows. A very long text
    counts whole, and its words may fill many blocks; equal quotients go to the
    first source or shard. An empty table gives an empty result. Other columns
    aren't read.
    """
    own = word_count(F.col(text_col)) if size is None else size
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), own.alias("size")).withColumn("row", F.xxhash64("source", "size")))
    stream = _stream(slim, weights, repeats, block, shard_words, max_shards, seed)

    def picked_before(at: str) -> str:
        """Words of the picked blocks before a place of the stream: block j is
        picked where (j * picked + turn) / n reaches another whole number."""
        j, upto = f"(({at}) div {block})", lambda j: f"(({j} * picked + turn) div greatest(n, 1))"
        return f"({block} * ({upto(j)} - turn div greatest(n, 1)) + ({upto(f'({j} + 1)')} - {upto(j)}) * (({at}) % {block}))"

    taken = F.expr(f"rounds * size + {picked_before('stop')} - {picked_before('stop - size')}")
    return stream.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _pieces(columns: list[str], text_col: str, chars_col: str, block: int):
    """Rows of the mix: each document as often as it is taken whole, and then its picked blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text_col))
            at, cut = [], []
            for i, (text, takes) in enumerate(zip(texts, batch.column("takes").to_pylist())):
                words = None
                for t in takes:
                    at += [i] * t["rounds"]
                    cut += [None] * t["rounds"]
                    if not t["picked"] or not t["size"]:
                        continue
                    start, stop = t["stop"] - t["size"], t["stop"]
                    j = np.arange(start // block, (stop - 1) // block + 1)
                    picked = j[((j + 1) * t["picked"] + t["turn"]) // t["n"] > (j * t["picked"] + t["turn"]) // t["n"]]
                    if len(picked) == len(j):
                        at.append(i)
                        cut.append(None)
                    elif len(picked):
                        words = words or Words(pa.array([text.as_py()]))
                        runs = np.split(picked, np.flatnonzero(np.diff(picked) > 1) + 1)
                        spans = [(max(int(r[0]) * block, start) - start, min((int(r[-1]) + 1) * block, stop) - start) for r in runs]
                        at.append(i)
                        cut.append("\n".join(words.data[words.starts[a] : words.ends[b - 1]].tobytes().decode() for a, b in spans))
            out = batch.take(pa.array(at, pa.int64()))
            columns_out = [out.column(c) for c in columns]
            if any(c is not None for c in cut):
                k = columns.index(text_col)
                columns_out[k] = pc.coalesce(pa.array(cut, columns_out[k].type), columns_out[k])
                if chars_col in columns and pa.types.is_integer(out.column(chars_col).type):
                    k = columns.index(chars_col)
                    columns_out[k] = pc.coalesce(pa.array([None if c is None else len(c) for c in cut], columns_out[k].type), columns_out[k])
            yield pa.RecordBatch.from_arrays(columns_out, columns)

    return rows


def take(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = 512, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document stands as often as
    it is taken whole, and once more with the words of its picked blocks if some
    are (``chars_col``, where there is one, then has that text's length).

    A null text and one without words isn't taken. A null source is a source of
    its own; a null id is a document like others. Repeated rows are documents of
    their own, and may swap their takes, which no result shows. A very long text
    is cut at blocks of its words. An empty table stays empty; other columns,
    whatever their names, are handed on."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    doc, row, nth = (f"{x}_of_" + "_".join(columns) for x in ("id", "row", "nth"))  # names that no column has
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), whole.alias("row")))
    stream = _stream(slim, weights, repeats, block, shard_words, max_shards, seed).where("size > 0")
    takes = stream.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias(doc), F.col("row").alias(row)).agg(F.collect_list(F.struct("rounds", "size", "stop", "n", "picked", "turn")).alias("takes"))
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))), row: whole})
    once = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(doc, row).orderBy(doc))).where(F.col(nth) == 1)  # repeated rows are equal: one stands for all their takes
    joined = once.join(takes.hint("shuffle_hash"), [doc, row]).select(*[F.col(f"`{c}`") for c in columns], "takes")
    return joined.mapInArrow(_pieces(columns, text_col, chars_col, block), docs.schema)
