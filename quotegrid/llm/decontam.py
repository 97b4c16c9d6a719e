"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k is cut into k + 1 pieces: k edits leave one of
them untouched. An Aho-Corasick automaton over all pieces finds their exact hits
in a text; each hit names the window in which the item would stand, and Myers'
bit-parallel algorithm decides whether the item is there within its budget.

The benchmark goes to the workers in blocks of bounded size; a larger benchmark
means more passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Edits allowed for each hundred characters of an item.
ERRORS_PER_100 = 8
#: Characters of benchmark text that one pass carries.
BLOCK_CHARS = 2_000_000
HIT_SCHEMA = "doc_id long, item_id long, errors int, start int, stop int"


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return len(item) * ERRORS_PER_100 // 100


def pieces(item: str) -> list[tuple[int, str]]:
    """The item cut into one piece more than its budget: (place, piece)."""
    n = budget(item) + 1
    edges = [round(i * len(item) / n) for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Myers' bit vectors of an item."""

    def __init__(self, item: str):
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to a stretch of the text, and the first place where such a stretch ends."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, least, end = full, 0, self.size, self.size, 0
        get = self.masks.get
        for i, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full  # the text may start anywhere
            plus = (mh << 1 & full) | ~(xv | ph) & full
            minus = ph & xv
            if score < least:
                least, end = score, i + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        named = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.ids = [i for i, _ in named]
        self.items = {k: (t, budget(t), Pattern(t), Pattern(t[::-1])) for k, (_, t) in enumerate(named)}
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (t, *_) in self.items.items():
            for at, piece in pieces(t):
                owners.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, errors, start, stop) of each item that the text holds: its best stretch."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, *hit in self._find(text):
            best[self.ids[k]] = min(best.get(self.ids[k], tuple(hit)), tuple(hit))
        for i, hit in best.items():
            yield (i, *hit)

    def _find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        if not self.items:
            return
        where: dict[int, list[int]] = {}
        for last, (n, who) in self.automaton.iter(text):
            for i, at in who:
                where.setdefault(i, []).append(last + 1 - n - at)
        for i, starts in where.items():
            item, k, forward, backward = self.items[i]
            m, best = len(item), (k + 1, 0)
            starts.sort()
            a = 0
            while a < len(starts) and best[0]:
                b = a
                while b + 1 < len(starts) and starts[b + 1] - starts[b] <= m + 2 * k:
                    b += 1
                lo, hi = max(0, starts[a] - k), starts[b] + m + k
                stretch = text[lo:hi]
                if stretch == item or (at := stretch.find(item)) >= 0:
                    best = (0, lo + (0 if stretch == item else at) + m)
                else:
                    errors, end = forward.best(stretch)
                    best = min(best, (errors, lo + end))
                a = b + 1
            if best[0] <= k:
                stop = best[1]
                back = text[max(0, stop - m - k) : stop][::-1]
                yield i, best[0], stop - max(1, self._reach(backward, back, best[0])), stop

    @staticmethod
    def _reach(pattern: Pattern, text: str, errors: int) -> int:
        """How far back a match with so many errors goes, at least."""
        for n in range(max(0, pattern.size - errors), min(len(text), pattern.size + errors) + 1):
            if pattern.best(text[:n])[0] <= errors:
                return n
        return min(len(text), pattern.size)


def _hits(items: list[tuple[int, str]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            out = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")) if text.is_valid for hit in matcher.find(normal(text.as_py()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "errors", "start", "stop"])

    return rows


def _blocks_of(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, about ``block_chars`` / 2 characters at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("item_id"), F.col(item_text_col).alias("text")).where("length(text) > 0").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // block_chars))
    for k in range(blocks):
        own = items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {k}")).orderBy("item_id", "text").collect()
        yield [(r[0], r[1]) for r in own]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row (doc_id, item_id, errors, start, stop) for each document and item
    that stands in it within the item's budget, case and white space aside; start
    and stop are characters of the normalised text, of the item's best stretch.

    Null and empty texts and items match nothing. A null item_id is given as -1;
    null doc_ids are carried. Repeated documents give repeated rows; of items with
    one id the best match counts, of equally good stretches the one that ends
    first. A very long text is searched whole. Empty tables give an empty result; other columns
    aren't read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for own in _blocks_of(benchmark, item_col, item_text_col, block_chars):
        found = texts.mapInArrow(_hits(own), HIT_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _clean(items: list[tuple[int, str]], text_col: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([next(matcher.find(normal(t.as_py())), None) is None for t in texts], pa.bool_()))

    return rows


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, whole, that hold no item of the benchmark within its
    budget. Null and empty texts and items match nothing, so such rows stay;
    repeated rows stay or go together; a very long text is searched whole; an empty
    benchmark drops nothing, and an empty table stays empty. Other columns,
    whatever their names, are handed on."""
    small_batches(docs.sparkSession)
    for own in _blocks_of(benchmark, item_col, item_text_col, block_chars):
        docs = docs.mapInArrow(_clean(own, text_col), docs.schema)
    return docs
