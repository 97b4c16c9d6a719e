"""Token ids in a content-addressed store.

A store is a folder of Parquet files:

* ``pieces/kind=chunk`` - key (the first 16 bytes of the chunk's SHA-256), n,
  payload (the ids as little-endian unsigned 16- or 32-bit integers, zstd).
  Every chunk is there once.
* ``recipes`` - the documents in ascending doc_id order (null ids last):
  part, place (in the part), doc_id, n_tokens, parts_before (tokens before it
  in its part), chunks (the chunks' keys, on end).
* ``manifest`` - a row for each part: first and last id, documents, tokens, and
  the root of the Merkle tree over its recipes; ``root`` over all parts' roots
  is in the last column of every row.

A rolling hash over 16 ids cuts a document's id stream, so that an edit changes
the chunks near it only and documents that share passages share chunks.
``verify`` checks every chunk against its key, and every part against its root.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, gathered, ragged, raw, shared_dir, small_batches, spread_join, window_hashes

KEY_BYTES = 16
#: Ids of a chunk: at least, on average (a power of two), at most; ids under the rolling hash.
LEAST, MEAN, MOST, ROLL = 128, 1024, 8192, 16
#: Segments whose ids a worker remembers.
CACHE_SEGMENTS = 1_500_000
#: Text bytes encoded at once.
ENCODE_BYTES = 4 << 20
PIECES = "kind string, key binary, doc_id long, n long, payload binary"

class Encoder:
    """A tokenizer of a file with the ids of segments seen before, in flat arrays:
    the segments' hashes in ascending order, a second hash that must agree too, and
    where their ids stand in ``ids``. When there are more than
    CACHE_SEGMENTS, those used most often stay."""

    SEPARATOR = b"\n"  # a pretoken of its own between segments without white space inside

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):  # no segment comes twice, so the library's own cache only costs
            self.tokenizer.model._resize_cache(0)
        self.between = self._encode([self.SEPARATOR.decode()])[0]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.hashes, self.checks = np.zeros(0, U64), np.zeros(0, np.uint32)
        self.begins, self.lengths, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.kind)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _fresh(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and ids of segments not seen before. Simple ones go into
        one text and are told apart by the separator's id."""
        simple = self._simple(names)
        parts: list[np.ndarray] = []
        lengths = np.zeros(len(names), np.int64)
        order = [*np.flatnonzero(simple).tolist(), *np.flatnonzero(~simple).tolist()]
        n = int(simple.sum())
        for i in range(0, n, 8192):
            own = [names[k] for k in order[i : min(i + 8192, n)]]
            ids = np.array(self._encode([self.SEPARATOR.join(own).decode()])[0], np.uint32)
            cut = np.flatnonzero(ids == self.between[0]) if len(self.between) == 1 else []
            if len(cut) == len(own) - 1:
                lengths[order[i : i + len(own)]] = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
                parts.append(np.delete(ids, cut))
            else:
                each = self._encode([x.decode() for x in own])
                lengths[order[i : i + len(own)]] = [len(x) for x in each]
                parts.append(np.array([y for x in each for y in x], np.uint32))
        each = self._encode([names[k].decode() for k in order[n:]])
        lengths[order[n:]] = [len(x) for x in each]
        parts.append(np.array([y for x in each for y in x], np.uint32))
        flat = np.concatenate(parts)
        begins = np.empty(len(names), np.int64)
        begins[order] = np.cumsum(lengths[order]) - lengths[order]
        return lengths, flat[ragged(begins, lengths)]

    @staticmethod
    def _simple(names: list[bytes]) -> np.ndarray:
        """Whether a segment has no white space beside one space at its start."""
        data = np.frombuffer(b"".join(names), np.uint8)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        begins = np.cumsum(lengths) - lengths
        white = _white(data)[0]
        white[begins[data[begins] == 32]] = False
        spaces = np.concatenate(([0], np.cumsum(white)))
        return (spaces[begins + lengths] == spaces[begins]) & ((lengths > 1) | (data[begins] != 32))

    def __call__(self, names: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct segments that occur ``counts`` times: where their ids begin in ``ids``, and how many they are."""
        texts = names.to_pylist()
        hashes, checks = np.fromiter(map(xxhash.xxh64_intdigest, texts), U64, len(texts)), np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))
        order = np.argsort(hashes)
        hashes, checks, counts = hashes[order], checks[order], counts[order]
        known = self._known(hashes)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > CACHE_SEGMENTS:
                self._forget(hashes[known])
            lengths, begins = self._add_ids([texts[i] for i in order[new].tolist()])
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.checks = np.insert(self.hashes, at, hashes[new]), np.insert(self.checks, at, checks[new])
            self.begins, self.lengths, self.used = np.insert(self.begins, at, begins), np.insert(self.lengths, at, lengths), np.insert(self.used, at, 0)
        at = np.searchsorted(self.hashes, hashes)
        self.used[at] += counts.astype(np.int32)
        begins, lengths = self.begins[at], self.lengths[at].astype(np.int64)
        other = np.flatnonzero(self.checks[at] != checks)  # another segment has this hash
        if len(other):
            lengths[other], begins[other] = self._add_ids([texts[i] for i in order[other].tolist()])
        out = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        out[0][order], out[1][order] = begins, lengths
        return out

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def _add_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids = self._fresh(texts)
        begins = np.cumsum(lengths) - lengths + len(self.ids)
        self.ids = np.concatenate((self.ids, ids.astype(self.kind)))
        return lengths, begins

    def _forget(self, needed: np.ndarray) -> None:
        """Keeps half of the segments, those used most, and the needed ones; their use counts half from now on."""
        keep = np.zeros(len(self.hashes), bool)
        keep[np.argsort(-self.used, kind="stable")[: CACHE_SEGMENTS // 2]] = True
        keep[np.searchsorted(self.hashes, needed)] = True
        self.ids = self.ids[ragged(self.begins[keep], self.lengths[keep])]
        self.hashes, self.checks, self.lengths, self.used = self.hashes[keep], self.checks[keep], self.lengths[keep], self.used[keep] // 2
        self.begins = np.cumsum(self.lengths, dtype=np.int32) - self.lengths


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The encoder of a file, kept for the worker's life."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin and bytes that end a white-space character, in the widest sense of any library."""
    one = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    starts, ends = one.copy(), one.copy()
    if len(data) > 1:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        starts[:-1] |= two
        ends[1:] |= two
    if len(data) > 2 and ((data >= 0xE1) & (data <= 0xE3)).any():
        a, b, c = data[:-2], data[1:-1], data[2:]
        three = ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        starts[:-2] |= three
        ends[2:] |= three
    return starts, ends


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces that a byte-level tokenizer never joins, and how many each text
    has: its pattern puts one space before a word and takes a lone line end by
    itself, so a cut before a space, and on both sides of a line end, between
    two characters that are not white space changes no id."""
    data, bounds = raw(texts)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        starts, ends = _white(data)
        lone = np.zeros(n, bool)
        lone[1:-1] = ~ends[:-2] & ~starts[2:]
        edge = bounds[(bounds > 0) & (bounds < n)]
        lone[edge] = lone[edge - 1] = False
        cut[:n] = lone & (data == 32)
        line = np.flatnonzero(lone & (data == 10))
        cut[line] = cut[line + 1] = True
    cut[bounds] = True
    cut[n] = True
    cut[0] = True
    at = np.flatnonzero(cut) if n else np.zeros(1, np.int64)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.diff(np.searchsorted(at, bounds))


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts on end, and how many each text has. Segments that
    repeat are encoded once. No special tokens are added."""
    pieces, per_text = segments(texts)
    if not len(pieces):
        return np.zeros(0, np.uint32), np.zeros(len(per_text), np.int64)
    found = pieces.dictionary_encode()
    codes = np.asarray(found.indices)
    encoder = _encoder(path)
    begins, lengths = encoder(found.dictionary, np.bincount(codes, minlength=len(found.dictionary)))
    each = lengths[codes]
    upto = np.concatenate(([0], np.cumsum(each)))
    edges = np.concatenate(([0], np.cumsum(per_text)))
    return encoder.ids[ragged(begins[codes], each)], np.diff(upto[edges])


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the ROLL ids before them asks for a cut."""
    return np.flatnonzero(window_hashes(ids.astype(U64) + U64(1), ROLL) & U64(MEAN - 1) == 0) + ROLL


def chunk_ends(hits: np.ndarray, start: int, stop: int) -> list[int]:
    """Where the chunks of the document at start:stop end: at the first asked cut
    after LEAST ids, MOST ids at most (the last may be shorter)."""
    out, at = [], start
    if stop - start > LEAST:
        own = hits[np.searchsorted(hits, start + LEAST) : np.searchsorted(hits, stop)].tolist()
        k = 0
        while stop - at > LEAST:
            while k < len(own) and own[k] < at + LEAST:
                k += 1
            at = min(own[k] if k < len(own) else stop, at + MOST, stop)
            out.append(at)
    if at < stop:
        out.append(stop)
    return out


def _pieces(path: str, end_id: int, width: int, kept_keys: int = 200_000):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen, sha = zstandard.ZstdCompressor(level=1).compress, set(), hashlib.sha256
        for chunk in gathered(batches, "text", ENCODE_BYTES):
            ids, lengths = encode(chunk.column("text"), path)
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            ends += np.arange(1, len(ends) + 1)
            data, hits = memoryview(ids.astype(f"<u{width}").tobytes()), cut_points(ids)
            kinds, names, docs, sizes, payloads = [], [], [], [], []
            start = 0
            for doc, stop in zip(chunk.column("doc_id").to_pylist(), ends.tolist()):
                keys, last = [], start
                for end in chunk_ends(hits, start, stop):
                    piece = data[last * width : end * width]
                    key = sha(piece).digest()[:KEY_BYTES]
                    keys.append(key)
                    if key not in seen:  # each task sends a chunk once, as far as it remembers
                        seen.add(key)
                        kinds.append("chunk")
                        names.append(key)
                        docs.append(None)
                        sizes.append(end - last)
                        payloads.append(pack(piece))
                    last = end
                keys = b"".join(keys)
                kinds.append("doc")
                names.append(sha(b"%d" % (doc or 0) + keys).digest()[:8])
                docs.append(doc)
                sizes.append(stop - start)
                payloads.append(keys)
                start = stop
            if len(seen) > kept_keys:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.binary()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())], ["kind", "key", "doc_id", "n", "payload"])

    return rows


def merkle(leaves: list[bytes]) -> bytes:
    """The root of the binary tree over the leaves' hashes; an odd one moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _leaf(doc_id: int | None, n: int, keys: bytes) -> bytes:
    return b"%s:%d:" % (b"" if doc_id is None else b"%d" % doc_id, n) + keys


class _Tree:
    """A Merkle root made leaf by leaf, with one open node for each level."""

    def __init__(self):
        self.open: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node, k = hashlib.sha256(b"\0" + leaf).digest(), 0
        while k < len(self.open) and self.open[k] is not None:
            node, self.open[k] = hashlib.sha256(b"\1" + self.open[k] + node).digest(), None
            k += 1
        if k == len(self.open):
            self.open.append(None)
        self.open[k] = node

    def root(self) -> bytes:
        node = None
        for x in self.open:
            node = x if node is None else node if x is None else hashlib.sha256(b"\1" + x + node).digest()
        return node or hashlib.sha256(b"").digest()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A manifest row for each part; a part's recipes come together and in order."""
    part, tree, row = None, None, None
    done: list[tuple] = []
    for batch in batches:
        for p, doc, n, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "chunks"))):
            if p != part:
                if tree:
                    done.append((*row, tree.root()))
                part, tree, row = p, _Tree(), [p, doc, doc, 0, 0]
            tree.add(_leaf(doc, n, keys))
            row[2], row[3], row[4] = doc, row[3] + 1, row[4] + n
    if tree:
        done.append((*row, tree.root()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "first_id", "last_id", "documents", "tokens", "root"])


def write_store(docs: DataFrame, tokenizer: str, *, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 2) -> str:
    """Encodes every text (null as an empty one), appends ``end_id``, writes the
    store and returns its path.

    The tokenizer is a file of the tokenizers library with byte-level pre-
    tokenization and no prefix space; id_bytes is 2 if all ids are below 65,536,
    else 4. Rows with equal or null doc_ids, repeated rows among them, are
    documents of their own; null ids come last, and rows with one id keep an order
    of their own. A very long text is encoded whole and cut into chunks. An empty
    table makes an empty store; other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark)
    if id_bytes < 4 and max(end_id, _encoder(tokenizer).tokenizer.get_vocab_size() - 1) >= 1 << 8 * id_bytes:
        raise ValueError(f"ids of {tokenizer} need more than {id_bytes} bytes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(_pieces(tokenizer, end_id, id_bytes), PIECES).withColumn("row", F.when(F.col("kind") == "doc", F.monotonically_increasing_id()))
    once = pieces.repartition("key").groupBy("kind", "key", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("payload").alias("payload"))  # every document row, equal chunks once
    once.drop("row").write.partitionBy("kind").parquet(f"{path}/pieces")
    found = spark.read.schema(PIECES).parquet(f"{path}/pieces").where("kind = 'doc'").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), "doc_id", F.col("n").alias("n_tokens"), F.col("payload").alias("chunks"))
    ordered = found.repartitionByRange("rank", "n_tokens", "chunks").sortWithinPartitions("rank", "n_tokens", "chunks").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered.select("part", "place", "doc_id", "n_tokens", "chunks").write.parquet(f"{path}/recipes")
    recipes = read_recipes(spark, path)
    manifest = recipes.repartition("part").sortWithinPartitions("part", "place").mapInArrow(_roots, "part int, first_id long, last_id long, documents long, tokens long, root binary")
    rows = sorted(tuple(r) for r in manifest.collect())  # a row for each part
    top, before, out = merkle([bytes(r[5]) for r in rows]), 0, []
    for r in rows:
        out.append((*r[:5], before, bytearray(r[5]), bytearray(top)))
        before += r[4]
    spark.createDataFrame(out, "part int, first_id long, last_id long, documents long, tokens long, tokens_before long, root binary, top binary").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, place long, doc_id long, n_tokens long, chunks binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIECES).parquet(f"{path}/pieces").where("kind = 'chunk'").select("key", "n", "payload")


def recipe_chunks(recipes: DataFrame) -> DataFrame:
    """A row (part, place, k, key) for the k-th chunk of each document."""
    keys = F.expr(f"posexplode(transform(sequence(0, octet_length(chunks) div {KEY_BYTES} - 1), i -> substring(chunks, i * {KEY_BYTES} + 1, {KEY_BYTES})))")
    return recipes.select("part", "place", keys.alias("k", "key"))


def _ids(payload: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), f"<u{width}").astype("<u4")


def _checked(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, n, crc, ok = batch.column("key"), [], [], []
            for key, payload in zip(keys.to_pylist(), batch.column("payload").to_pylist()):
                data = unpack(payload)
                ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                ok.append(hashlib.sha256(data).digest()[:KEY_BYTES] == key)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok)], ["key", "n", "crc", "ok"])

    return rows


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32 (highest power in the lowest bit)."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


_shifts: dict[int, int] = {}


def crc_joined(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings on end, from theirs and the second's length."""
    if length not in _shifts:
        if len(_shifts) > 100_000:
            _shifts.clear()
        power, x, n = 1 << 31, 1 << 23, length  # x**8 for each byte
        while n:
            if n & 1:
                power = _times(power, x)
            x = _times(x, x)
            n >>= 1
        _shifts[length] = power
    return _times(_shifts[length], first) ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, sums = [], []
        for chunks in batch.column("found").to_pylist():
            crc = n = 0
            for c in chunks:
                crc = crc_joined(crc, c["crc"], 4 * c["n"]) if n else c["crc"]
                n += c["n"]
            crcs.append(crc)
            sums.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("place"), pa.array(sums, pa.int64()), pa.array(crcs, pa.int64())], ["part", "place", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """From the files alone, a row for each document: doc_id, start (ids before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit
    integers). Each chunk is read and summed once; a document's sum is put
    together from its chunks' sums and lengths, however long it is. Documents with
    one id have a row each, in the order of the store; a store without documents
    gives no row."""
    small_batches(spark)
    sums = read_chunks(spark, path).mapInArrow(_checked(id_bytes), "key binary, n long, crc long, ok boolean").where("ok").select("key", "n", "crc")
    recipes = read_recipes(spark, path)
    needed = recipe_chunks(recipes)
    docs = spread_join(needed, sums, ["key"]).groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc"))).alias("found"))
    whole = docs.mapInArrow(_joined, "part int, place long, n_tokens long, ids_crc32 long")
    parts = spark.read.schema("part int, tokens_before long").parquet(f"{path}/manifest")
    order = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("part", "place", "doc_id", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before")).join(parts, "part")
    return placed.join(whole, ["part", "place"]).select("doc_id", (F.col("tokens_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _documents(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids(c["payload"], width) for c in found]) for found in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return rows


def read_ids(spark: SparkSession, path: str, where: str = "true", id_bytes: int = 2) -> DataFrame:
    """The documents that fit a condition on the recipes, with all their ids."""
    small_batches(spark)
    recipes = read_recipes(spark, path).where(where)
    needed = recipe_chunks(recipes)
    found = spread_join(needed, read_chunks(spark, path), ["key"]).groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("k", "payload"))).alias("found"))
    return recipes.join(found, ["part", "place"]).select("doc_id", "found").mapInArrow(_documents(id_bytes), "doc_id long, ids array<long>")


def verify(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """Rows (finding, n): chunks that don't match their key, chunks stored twice,
    recipes' chunks that are missing, and parts whose Merkle root differs. All
    are 0 in a sound store."""
    small_batches(spark)
    sums = read_chunks(spark, path).mapInArrow(_checked(id_bytes), "key binary, n long, crc long, ok boolean")
    needed = recipe_chunks(read_recipes(spark, path))
    now = read_recipes(spark, path).repartition("part").sortWithinPartitions("part", "place").mapInArrow(_roots, "part int, first_id long, last_id long, documents long, tokens long, root binary")
    stored = spark.read.schema("part int, root binary").parquet(f"{path}/manifest").withColumnRenamed("root", "stored")
    found = {
        "bad_chunks": sums.where("not ok"),
        "double_chunks": sums.groupBy("key").count().where("count > 1"),
        "missing_chunks": needed.join(sums.where("ok").select("key"), "key", "left_anti"),
        "bad_parts": now.join(stored, "part", "full").where(~F.col("root").eqNullSafe(F.col("stored"))),
    }
    out = [df.agg(F.lit(name).alias("finding"), F.count("*").alias("n")) for name, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
