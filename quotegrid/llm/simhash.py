"""SimHash near-dedup by a self-join of binary tries.

Every text gets a 64-bit fingerprint. Equal fingerprints become one, and the
distinct ones are dealt by pigeonhole: of five bit blocks, two fingerprints with
four differing bits or fewer share one unchanged. A bucket (block, value) is a
trie of the other bits, and the join walks pairs of its nodes together: each
step adds the bits in which two children differ, and a pair whose sum exceeds
the budget is left with everything below it. Buckets that hold many fingerprints
are dealt again by five blocks of their other bits, and again, so that the work
of one task stays bounded; a task takes its buckets one after another. A bucket
gives a spanning forest of its links (one edge for each fingerprint at most),
never all pairs of a group, and components over these edges name the groups.

A budget of four bits finds equal and almost equal fingerprints. ``nearcopies``
is the same join for texts that agree by a share of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_HOT_KEYS, NULL_ID, U64, ragged, small_batches, spread_join, whole_groups, written
from .components import components

SHINGLE, BITS, BUDGET = 4, 64, 4
#: Fingerprints of a bucket above which it is dealt again.
LARGE_BUCKET = 20_000
#: How often buckets are dealt at most.
DEALS = 4
LEAF_PAIRS, FRONT = 256, 1 << 12


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles: A-Z lower-cased, words joined by
    one space, XXH64 with seed 42; a bit is 1 if set in over half of the hashes."""
    words = b" ".join(text.lower().split())
    if not words:
        return 0
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    if len(spaces) + 1 <= shingle:
        return xxhash.xxh64_intdigest(words, 42)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(words[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])], U64)
    total, half = np.zeros(BITS, np.int64), len(hashes)
    for i in range(0, half, 4096):
        total += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > half).tobytes(), "big")


def _prints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(np.array(found, U64).view(np.int64))], ["doc_id", "own", "print"])

    return rows


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, own (the text's hash) and print (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("own"), F.col(text_col).alias("text")).mapInArrow(_prints(shingle), "doc_id long, own long, print long")


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """n blocks (lowest bit, width) of ``bits`` bits."""
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(mask: int, budget: int) -> list[int]:
    """``mask`` with each of budget + 1 blocks of the bits that it lacks."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    out = [mask | sum(1 << b for b in free[low : low + width]) for low, width in _blocks(len(free), budget + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


class Forest:
    """Sets of places that grow together; each is named by its smallest place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        y = self.up[x]
        while not np.array_equal(z := self.up[y], y):
            y = z
        return y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        first = (a, b)
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
        for x in first:  # shortens the ways of the places that were touched
            self.up[x] = self.roots(x)


def near_pairs(keys: np.ndarray, run: np.ndarray, budget: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j) of ``keys`` that are in one run (ascending there)
    and differ in ``budget`` bits or fewer, in pieces; of equal ``label`` none.

    A front of node pairs (ranges of places) goes down the tries a bit at a time;
    small pairs are compared outright, and a large front is worked off in pieces.
    Two nodes that hold one and the same label are left with all below them.
    """
    heads = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(keys)]))
    wide = np.flatnonzero(np.diff(heads) > 1)
    lo, hi = heads[wide], heads[wide + 1]
    turns = None if label is None else np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), np.zeros(len(lo), np.int8))]
    while stack:
        front = stack.pop()
        if len(front[0]) > FRONT:
            half = len(front[0]) // 2
            stack += [tuple(x[:half] for x in front), tuple(x[half:] for x in front)]
            continue
        if turns is not None:
            al, ah, bl, bh, _, _ = front
            mixed = (turns[ah - 1] != turns[al]) | (turns[bh - 1] != turns[bl]) | (label[al] != label[bl])
            front = tuple(x[mixed] for x in front)
        al, ah, bl, bh, err, depth = front
        leaf = ((ah - al) * (bh - bl) <= LEAF_PAIRS) | (depth >= BITS)
        if leaf.any():
            a, b, m = al[leaf], bl[leaf], bh[leaf] - bl[leaf]
            n = (ah[leaf] - a) * m
            pair, at = np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n)), n)
            i, j = a[pair] + at // m[pair], b[pair] + at % m[pair]
            near = i < j
            near[near] = np.bitwise_count(keys[i[near]] ^ keys[j[near]]) <= budget
            if label is not None:
                near[near] = label[i[near]] != label[j[near]]
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, err, depth = (x[~leaf] for x in front)
        if not len(al):
            continue
        bit = U64(1) << (U64(BITS - 1) - depth.astype(U64))
        am, bm = _split(keys, al, ah, bit), _split(keys, bl, bh, bit)
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am, ah, bl, bm, err + 1)]
        new = [np.concatenate([c[k] for c in children]) for k in range(5)]
        good = (new[4] <= budget) & (new[1] > new[0]) & (new[3] > new[2])
        good &= (new[0] != new[2]) | (new[1] - new[0] > 1)
        good[3 * len(al) :] &= al != bl  # a node beside itself has this pair already
        stack.append((*(x[good] for x in new), np.tile(depth + 1, 4)[good]))


def trie_join(keys: np.ndarray, run: np.ndarray, budget: int, links: Forest) -> None:
    """Joins in ``links`` all places that ``near_pairs`` gives."""
    for i, j in near_pairs(keys, run, budget):
        links.join(i, j)


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """In each range, ascending and equal above the bit, the first place where it is 1."""
    lo, hi = lo.copy(), hi.copy()
    while (todo := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (keys[np.where(todo, mid, 0)] & bit) != 0
        hi = np.where(todo & one, mid, hi)
        lo = np.where(todo & ~one, mid + 1, lo)
    return lo


def _bucket_links(budget: int):
    """For rows (mask, bucket, print), whole buckets together: edges (a, b) of a spanning forest of each bucket's links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["mask", "bucket"]):
            mask, bucket, keys = (np.asarray(table.column(c)) for c in ("mask", "bucket", "print"))
            keys = keys.view(U64)
            order = np.lexsort((keys, bucket, mask))
            mask, bucket, keys = mask[order], bucket[order], keys[order]
            run = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1]))))
            links = Forest(len(keys))
            trie_join(keys, run, budget, links)
            root = links.roots(np.arange(len(keys)))
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(keys[root[moved]].view(np.int64)), pa.array(keys[moved].view(np.int64))], ["a", "b"])

    return rows


def links(prints: DataFrame, *, budget: int = BUDGET, large: int = LARGE_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct values of ``print`` that join all values
    reachable over ``budget`` differing bits or fewer.

    A bucket is named by the bits that it fixes (mask) and their values. Buckets
    above ``large`` (or, if that is more, one part in MOST_HOT_KEYS of all rows) are dealt again by blocks of their free bits, up to DEALS
    times: what agrees but for the budget shares one of these blocks too.
    """
    spark = prints.sparkSession
    small_batches(spark)
    masks = _masks(0, budget)
    key = ["mask", "bucket"]
    dealt = prints.select("print", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("print", "mask", F.col("print").bitwiseAND(F.col("mask")).alias("bucket"))
    done = None
    for _ in range(DEALS - 1):
        most = max(large, dealt.count() // MOST_HOT_KEYS + 1)  # so there are never more large buckets than can be broadcast
        full = written(dealt.groupBy(*key).count().where(F.col("count") > most).select(*key))
        if full.isEmpty():
            break
        known = F.broadcast(full)
        parts = F.broadcast(spark.createDataFrame([(m, _masks(m & (1 << BITS) - 1, budget)) for m in masks], "mask long, parts array<long>"))  # (budget + 1) ** DEALS masks at most
        rest = dealt.join(known, key, "left_anti").select("print", *key)
        done = rest if done is None else done.union(rest)
        deeper = dealt.join(known, key, "left_semi").join(parts, "mask").select("print", F.explode("parts").alias("mask"))
        dealt = written(deeper.select("print", "mask", F.col("print").bitwiseAND(F.col("mask")).alias("bucket")))
        masks = sorted({p for m in masks for p in _masks(m & (1 << BITS) - 1, budget)})
    dealt = dealt if done is None else done.union(dealt)
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bucket_links(budget), "a long, b long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """A row for each row of ``docs``: doc_id, own (the text's hash), print, label
    (its component's smallest fingerprint), component_id (the smallest doc_id in
    reach over links, its own included).

    A null text and one without words have fingerprint 0 and are linked like any
    other. A null doc_id gets its component's smallest id, null if there is none.
    Repeated rows share fingerprint and component; of equal distances all link. A
    very long text is read whole. An empty table gives an empty result; other
    columns aren't read.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("print"), budget=budget))
    named = distinct.join(labels, distinct["print"] == labels["node"], "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return spread_join(prints, named.join(least, "label").select("print", "label", "component_id"), ["print"]).select("doc_id", "own", "print", "label", "component_id")


def first_of_each(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without near copies: of each label in ``found``
    (doc_id, own, label) the row with the smallest doc_id (a null one last, then
    the smallest text hash) stays, and of repeated rows one."""
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))), F.xxhash64(F.col(text_col))]
    first = found.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("id"), "own")).alias("first")).select("first.id", "first.own")
    doc, own, row = (f"{x}_of_" + "_".join(docs.columns) for x in ("id", "own", "row"))  # names that no column has
    kept = docs.withColumns({doc: key[0], own: key[1]}).join(first.select(F.col("id").alias(doc), F.col("own").alias(own)), [doc, own], "left_semi")
    same = Window.partitionBy(doc, own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn(row, F.row_number().over(same)).where(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, whole, without near copies: of each component the row that ``first_of_each`` takes."""
    return first_of_each(docs, groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, budget=budget), id_col=id_col, text_col=text_col)
