"""Pieces shared by the training-data operators: table access, written
intermediates, and vectorised word splitting over Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this package, is a run of bytes other than these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 4 << 20
#: Rows in an Arrow batch, so that a batch of long texts stays small.
ARROW_ROWS = 512
U64 = np.uint64
NULL_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of the Arrow batches that this package's workers get."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder that driver and executors share
    (``spark.checkpoint.dir``). Without that setting a local session gets a
    folder of its own; on a cluster it is an error, since executors would write
    where nobody else can read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends
    there, and a lost executor costs no more than reading the files."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key is hot from so many rows on, or from one part in so many of all rows: so there are never more hot keys than that.
HOT_ROWS, MOST_HOT_KEYS = 1024, 100_000


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of ``df`` (a table that is cheap to read again) with very many
    rows and the number of ``slots`` over which each is to be dealt: at most
    MOST_HOT_KEYS rows by their definition, so they can be broadcast. None without any."""
    at = max(HOT_ROWS, df.count() // MOST_HOT_KEYS + 1)
    hot = written(df.groupBy(*keys).count().where(F.col("count") > at).select(*keys, F.ceil(F.col("count") / at).cast("long").alias("slots")))
    return None if hot.isEmpty() else hot


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` (cheap to read again) joined with ``right``, which has a row or few
    for each key: the rows of a hot key of ``left`` are dealt over slots by their
    hash, and ``right`` has a copy for each of them."""
    hot = hot_keys(left, keys)
    if hot is None:
        return left.join(right, keys, how)
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("slots")), F.lit(0).cast("long"))).drop("slots")
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("slot", F.explode(F.expr("sequence(0L, coalesce(slots, 1L) - 1)"))).drop("slots")
    return dealt.join(copies, [*keys, "slot"], how).drop("slot")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows_at_once: int = 1 << 16) -> Iterator[pa.Table]:
    """From rows that stand together by ``keys`` (longs or ints), tables of whole
    groups, about so many rows at a time, so that a partition is never held whole."""
    held: list[pa.RecordBatch] = []
    n, wait = 0, rows_at_once
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < wait:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(n, bool)
        for k in keys:
            values = np.asarray(whole.column(k))
            other |= values != values[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last group may go on in the next batch
        if cut:
            yield whole.slice(0, cut)
        held, n = whole.slice(cut).combine_chunks().to_batches(), n - cut
        wait = max(rows_at_once, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on the input."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(np.asarray(lengths, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about ``limit`` bytes of text: small
    batches are put together, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if size >= limit:
            for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from text_chunks(whole, column, limit)
            held, size = [], 0
    if held:
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from text_chunks(whole, column, limit)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each text starts (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Words:
    """The words of a chunk of texts: ``codes`` index ``unique``; the words of
    text ``i`` are ``offsets[i]:offsets[i + 1]``; ``starts`` and ``ends`` are
    their places in ``data``."""

    def __init__(self, texts: pa.Array, lower: bool = False, is_word: np.ndarray | None = None):
        """is_word: for each byte value, whether it belongs to a word."""
        data, bounds = raw(texts)
        self.data = data = lowered(data) if lower else data
        if is_word is None:
            inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        else:
            inside = is_word[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[bounds[:-1]] = True
        first = first[:n]
        starts = np.flatnonzero(inside & (first | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
        last = np.zeros(n + 1, bool)
        last[bounds[1:]] = True
        last = last[1:]
        ends = np.flatnonzero(inside & (last | ~np.concatenate((inside[1:], [False])))) + 1 if n else np.zeros(0, np.int64)
        self.starts, self.ends, self.bounds = starts, ends, bounds
        self.offsets = np.searchsorted(starts, bounds)
        self.offsets[-1] = len(starts)
        self.n = np.diff(self.offsets)
        k = len(starts)
        if k:
            cuts = np.empty(2 * k, np.int32)
            cuts[0::2], cuts[1::2] = starts, ends
            pieces = pa.BinaryArray.from_buffers(pa.binary(), 2 * k - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
            found = pieces.dictionary_encode()
            self.codes, self.unique = np.asarray(found.indices)[0::2], found.dictionary
        else:
            self.codes, self.unique = np.zeros(0, np.int32), pa.array([], pa.binary())

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        h = xxhash.xxh64_intdigest
        own = np.fromiter((h(x) for x in self.unique.to_pylist()), U64, len(self.unique))
        return own[self.codes] if len(self.codes) else np.zeros(0, U64)


#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, U64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known, dtype=U64)
    return known[:n]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64, then mixed) of all windows of ``width``
    consecutive values; empty if there are fewer values."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    up, down = _power(BASE, n), _power(pow(BASE, -1, 1 << 64), n)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values * up, dtype=U64)))
    return mix64((total[width:] - total[:-width]) * down[: n - width + 1] + U64(width))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... (length of them) of each piece, on end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    shift = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    if total < 1 << 30 and np.abs(shift).max(initial=0) < 1 << 30:
        shift = shift.astype(np.int32)
    out = np.repeat(shift, lengths)
    out += np.arange(total, dtype=out.dtype)
    return out


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values cut from ``data`` (bytes) at ``offsets``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
