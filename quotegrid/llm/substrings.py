"""Substring dedup: windows of words that an earlier document also holds.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. So that
windows meet without a shuffle row for each, they travel in groups: the
windows of a stretch whose smallest ``width // 2``-word hash (their *anchor*)
is the same go as one row with the anchor as key. Equal windows have equal
anchors, so all their copies meet in one partition, sorted by anchor and
document; a window counts as repeated if a smaller document id had it. A pair
of windows must agree in the anchor (64 bits) and in its own hash (48 bits).

Anchors of very frequent passages are found in a sample of documents (which
decides only the route, never a result): their windows go one by one, find
their first document by map-side sums, and get it back by a join that deals the
rows of a frequent window over many tasks.

Runs of repeated windows become removal intervals; they go back to their
documents, and the words outside are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, Words, binary_array, mix64, ragged, small_batches, spread_join, text_chunks, window_hashes, written

WIDTH = 50
HASH_BYTES = 6
#: One document in so many is looked at for frequent anchors, which have at least this many documents of the
#: sample, and one part in MOST_HOT of all that it holds: so there are never more, and a million longs can be broadcast.
SAMPLE_ONE_IN, HOT_IN_SAMPLE, MOST_HOT = 64, 32, 1_000_000
WINDOW_SCHEMA = "anchor long, doc long, print long, start int, hashes binary"
REPEAT_SCHEMA = "doc long, print long, start int, stop int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1])


def _windows(batches: Iterator[pa.RecordBatch], width: int, sample: int = 0) -> Iterator[tuple]:
    """For each chunk: the valid window starts, their text, anchor and hash, and the chunk's ids and prints."""
    part = width // 2
    for batch in batches:
        for chunk in text_chunks(batch, "text"):
            words = Words(chunk.column("text"))
            if len(words.codes) < width:
                continue
            h = words.hashes()
            text = words.text_of_word()
            anchors = _sliding_min(window_hashes(h, part), width - part + 1)
            starts = np.flatnonzero(text[: len(h) - width + 1] == text[width - 1 :])
            yield chunk, words, starts, text[starts], anchors[starts], (lambda h=h, starts=starts: window_hashes(h ^ U64(0x5851F42D4C957F2D), width)[starts])


def _runs(same: np.ndarray) -> np.ndarray:
    """Where runs begin, and the end; same[i]: whether place i + 1 continues place i."""
    return np.concatenate(([0], np.flatnonzero(~same) + 1, [len(same) + 1]))


def _emit(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, starts, text, anchors, hashes in _windows(batches, width):
            if not len(starts):
                continue
            cut = _runs((anchors[1:] == anchors[:-1]) & (text[1:] == text[:-1]) & (starts[1:] == starts[:-1] + 1))
            at = cut[:-1]
            data = np.ascontiguousarray(hashes()).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].reshape(-1)
            ids, prints = (np.asarray(chunk.column(c)) for c in ("doc", "print"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[at].view(np.int64)), pa.array(ids[text[at]]), pa.array(prints[text[at]]), pa.array((starts[at] - words.offsets[text[at]]).astype(np.int32)), binary_array(data, cut * HASH_BYTES)],
                ["anchor", "doc", "print", "start", "hashes"],
            )

    return rows


def _sample_anchors(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, starts, text, anchors, _ in _windows(batches, width):
            if len(starts):
                pairs = np.unique(np.stack((text.view(U64) if text.dtype == U64 else text.astype(U64), anchors)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["anchor"])

    return rows


def _hashes48(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    return wide.reshape(-1).view(U64)


def _decide(batch: pa.RecordBatch, width: int) -> pa.RecordBatch | None:
    """Removal intervals from whole anchor groups, in the order of anchor and document."""
    anchors, docs, prints, starts = (np.asarray(batch.column(c)) for c in ("anchor", "doc", "print", "start"))
    blob = batch.column("hashes")
    offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
    hashes = _hashes48(np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    n = np.diff(offsets) // HASH_BYTES
    row = np.repeat(np.arange(len(n)), n)
    key = mix64(mix64(anchors.view(U64))[row] ^ hashes)
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1))
    first = np.repeat(docs[row[order[head]]], np.diff(np.append(head, len(order))))
    repeated = np.zeros(len(order), bool)
    repeated[order] = docs[row[order]] > first
    return _intervals(repeated, row, np.repeat(starts, n) + ragged(np.zeros(len(n)), n), docs, prints, width)


def _intervals(repeated, row, start, docs, prints, width) -> pa.RecordBatch | None:
    at = np.flatnonzero(repeated)
    if not len(at):
        return None
    cut = _runs((at[1:] == at[:-1] + 1) & (row[at[1:]] == row[at[:-1]]))
    head, tail = at[cut[:-1]], at[cut[1:] - 1]
    return pa.RecordBatch.from_arrays([pa.array(docs[row[head]]), pa.array(prints[row[head]]), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + width).astype(np.int32))], ["doc", "print", "start", "stop"])


def _match(width: int, windows_at_once: int = 1 << 18):
    """Decides whole anchor groups, about so many windows at once: a row may hold
    very many windows, where a text repeats one word."""

    def size(batch: pa.RecordBatch) -> int:
        return (pc.sum(pc.binary_length(batch.column("hashes"))).as_py() or 0) // HASH_BYTES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, wait = 0, windows_at_once
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += size(batch)
            if n < wait:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchors = np.asarray(whole.column("anchor"))
            cut = int(np.flatnonzero(anchors == anchors[-1])[0])  # the last group may go on in the next batch
            held = [whole.slice(cut)]
            n = size(held[0])
            wait = max(windows_at_once, 2 * n)
            if cut and (out := _decide(whole.slice(0, cut), width)) is not None:
                yield out
        if held and (out := _decide(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)) is not None:
            yield out

    return rows


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the groups."""
    for batch in batches:
        blob = batch.column("hashes")
        offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
        hashes = _hashes48(np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        n = np.diff(offsets) // HASH_BYTES
        spread = lambda c: np.repeat(np.asarray(batch.column(c)), n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread("anchor"), hashes.view(np.int64), spread("doc"), spread("print"), (spread("start") + ragged(np.zeros(len(n)), n)).astype(np.int32))], ["anchor", "hash", "doc", "print", "start"])


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: list[int] | None = None) -> DataFrame:
    """Intervals of words, a row (doc, print, start, stop) for each run of
    windows that start in a document with a smaller id too. ``doc`` is the id
    (the largest long for a null one, which so comes last), ``print`` the text's
    hash, for ids that repeat. hot: anchors known to be frequent, instead of the sample's."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("doc"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).alias("text"))
    if hot is None:
        some = texts.where(F.expr(f"pmod(xxhash64(doc, print), {SAMPLE_ONE_IN}) = 0")).select("text")
        counts = written(some.mapInArrow(_sample_anchors(width), "anchor long").groupBy("anchor").count())
        least = max(HOT_IN_SAMPLE, (counts.agg(F.sum("count")).first()[0] or 0) // MOST_HOT + 1)
        often = counts.where(F.col("count") >= least).select("anchor")
    else:
        often = spark.createDataFrame([(a,) for a in hot], "anchor long")
    n, often = often.count(), F.broadcast(often)
    groups = texts.mapInArrow(_emit(width), WINDOW_SCHEMA)
    rare = groups.join(often, "anchor", "left_anti") if n else groups
    found = rare.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(_match(width), REPEAT_SCHEMA)
    if n:
        one = written(groups.join(often, "anchor", "left_semi").mapInArrow(_singles, "anchor long, hash long, doc long, print long, start int"))
        least = one.groupBy("anchor", "hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
        found = found.unionByName(spread_join(one, least, ["anchor", "hash"]).where("doc > least").select("doc", "print", "start", (F.col("start") + width).alias("stop")))
    return found


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept, spans = [], [], [], []
        for text, found in zip(batch.column("text"), batch.column("runs").to_pylist()):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            if found:
                gone = np.zeros(len(words) + 1, np.int64)
                for r in found:
                    gone[r["start"]] += 1
                    gone[r["stop"]] -= 1
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                n_removed.append(len(words) - len(stay))
                words = [words[i] for i in stay]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: list[int] | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words
    that stay, joined by one space).

    A null text has no words. Documents with a null id count as later than all
    others and not as earlier than each other; rows with one id, repeated rows
    among them, don't count as earlier than each other. A very long text is cut
    nowhere: a window may start at any of its words. An empty table gives an empty
    result; other columns aren't read.
    """
    spark = docs.sparkSession
    runs = repeats(docs, id_col=id_col, text_col=text_col, width=width, hot=hot).groupBy("doc", "print").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.withColumn("doc", F.coalesce("doc_id", F.lit(int(NULL_ID)))).withColumn("print", F.xxhash64("text"))
    joined = keyed.join(runs.hint("shuffle_hash"), ["doc", "print"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")


#: The query's rows by whole windows as texts.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT rid, doc_id, s, array_to_string(w[s:s + {WIDTH - 1}], ' ') AS k FROM d, unnest(range(1, len(w) - {WIDTH - 2})) t(s) WHERE len(w) >= {WIDTH}),
f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k),
r AS (SELECT rid, s FROM v JOIN f USING (k) WHERE doc_id > first),
g AS (SELECT DISTINCT rid, p FROM r, unnest(range(s, s + {WIDTH})) t(p)),
a AS (SELECT rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM a ANTI JOIN g USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
