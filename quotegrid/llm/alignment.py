"""Alignment of two tokenizers over the same bytes.

Both token streams of a text cover the bytes of a space and the text. The union
of their end offsets cuts these bytes into elementary intervals; each interval
lies in one token of either stream (its owners), so it is one overlap; an
interval whose end both streams share closes a group. ``overlaps`` gives owners
and shared ends, ``products`` all pairs inside the groups, and ``ends`` the
pairs of tokens that end together, which are what the corpus counts.

Two tokens that end together agree in their last bytes, so one's bytes end with
the other's: there are never more such id pairs than the vocabularies have such
suffixes (``Pairs``; some hundred thousand). That bounds the table of counts,
which is why it may be collected and broadcast however large the corpus is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, gathered, ragged, raw, shared_dir, small_batches
from .tokenstore import Encoder, segments

#: Text bytes aligned at once, and segments, and bytes of their groups, that a worker remembers.
ALIGN_BYTES, MOST_SEGMENTS, MOST_BYTES = 2 << 20, 600_000, 32 << 20
#: No piece of the second vocabulary joins this with anything else.
LINE = "\n"


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval the tokens that own it, and whether both end with it."""
    edges = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
    return a, b, (ends_a[a] == edges) & (ends_b[b] == edges)


def products(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that stand in one group."""
    last_a, last_b = a[shared], b[shared]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    return np.repeat(ragged(last_a - n_a + 1, n_a), np.repeat(n_b, n_a)), ragged(np.repeat(last_b - n_b + 1, n_a), np.repeat(n_b, n_a))


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary has for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Vocabulary:
    """The bytes of all tokens, on end."""

    def __init__(self, names: list[bytes]):
        self.names = names
        self.lengths = np.fromiter(map(len, names), np.int64, len(names))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(names), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.begins[ids], self.lengths[ids])]


class Pairs:
    """The id pairs of which one's bytes end with the other's, numbered in ascending order."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.width = len(b.names)
        found = set()
        for one, other, key in ((a, b, lambda i, j: i * self.width + j), (b, a, lambda i, j: j * self.width + i)):
            by_name: dict[bytes, list[int]] = {}
            for j, name in enumerate(other.names):
                if name:
                    by_name.setdefault(name, []).append(j)
            for i, name in enumerate(one.names):
                for at in range(len(name)):
                    found.update(key(i, j) for j in by_name.get(name[at:], ()))
        self.keys = np.array(sorted(found), np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b)

    def second(self) -> np.ndarray:
        return self.keys % self.width


class Tokenizers:
    """The two tokenizers of a worker, what their tokens' bytes are, and the segments aligned before."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        size = self.a.tokenizer.get_vocab_size()
        special = set(self.a.tokenizer.get_added_tokens_decoder())
        self.vocab_a = Vocabulary([b"" if i in special else bytes(letters[x] for x in self.a.tokenizer.id_to_token(i)) for i in range(size)])
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vocab_b = Vocabulary([b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])
        # segments are cut before a space and around a line end: no piece may reach over either
        whole = [x for i, x in enumerate(names) if not self.b.is_byte(i)]
        self.cuts = not any("▁" in x.lstrip("▁") or LINE in x for x in whole)
        line = self.b.encode(LINE)
        self.head = len(line)  # what a line end before a segment costs: the prefix and itself
        self.line = line[-1]
        self.cuts &= line == [self.b.piece_to_id("▁"), self.line]
        self.forget()

    def forget(self) -> None:
        """Nothing is known any more. ``groups`` holds the written groups of all
        known segments, a semicolon after each; ``links`` their link codes."""
        self.known: dict[bytes, int] = {}
        self.n_a, self.n_b, self.n_links, self.n_text, self.used = (np.zeros(0, np.int32) for _ in range(5))
        self.groups, self.links = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self._place()

    def _place(self) -> None:
        """Where each segment's groups and links begin."""
        self.text_at = np.cumsum(self.n_text, dtype=np.int64) - self.n_text
        self.links_at = np.cumsum(self.n_links, dtype=np.int64) - self.n_links

    def keep_most_used(self, names: list[bytes]) -> None:
        """Forgets all but half of the segments, those used most (and the given ones); their use counts half from now on."""
        keep = np.zeros(len(self.used), bool)
        keep[np.argsort(-self.used, kind="stable")[: min(MOST_SEGMENTS, len(self.used)) // 2]] = True
        keep &= np.cumsum(np.where(keep, self.n_text, 0)) <= MOST_BYTES // 2
        keep[[self.known[x] for x in names if x in self.known]] = True
        self.groups = self.groups[ragged(self.text_at[keep], self.n_text[keep])]
        self.links = self.links[ragged(self.links_at[keep], self.n_links[keep])]
        self.n_a, self.n_b, self.n_links, self.n_text, self.used = self.n_a[keep], self.n_b[keep], self.n_links[keep], self.n_text[keep], self.used[keep] // 2
        place = np.cumsum(keep) - 1
        self.known = {x: int(place[i]) for x, i in self.known.items() if keep[i]}
        self._place()

    def encode_b(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each segment has, and all ids. Those without a line end go into one text and are told apart by it."""
        lengths, parts, order = np.zeros(len(names), np.int64), [], []
        simple = [i for i, x in enumerate(names) if b"\n" not in x]
        for at in range(0, len(simple), 4096):
            own = simple[at : at + 4096]
            ids = np.array(self.b.encode("".join(LINE + names[i].decode() for i in own), num_threads=1), np.int64)
            line = np.flatnonzero(ids == self.line)
            lengths[own] = np.diff(np.append(line, len(ids))) - 1
            parts.append(np.delete(ids, line)[self.head - 1 :])
            order += own
        rest = sorted(set(range(len(names))) - set(simple))
        for i in rest:
            ids = self.b.encode(LINE + names[i].decode(), num_threads=1)[self.head :]
            lengths[i] = len(ids)
            parts.append(np.array(ids, np.int64))
        order += rest
        flat = np.concatenate([np.zeros(0, np.int64), *parts])
        begins = np.empty(len(names), np.int64)
        begins[order] = np.cumsum(lengths[order]) - lengths[order]
        return lengths, flat[ragged(begins, lengths)]

    def add(self, names: list[bytes], pairs: Pairs) -> None:
        """Aligns new segments, all at once, and remembers them."""
        n_a, ids_a = self.a._fresh(names)
        n_b, ids_b = self.encode_b(names)
        ids_a = ids_a.astype(np.int64)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        good = _same(self.vocab_a, n_a, ids_a, names, sizes) & _same(self.vocab_b, n_b, ids_b, names, sizes)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, -1), np.where(good, n_b, -1)
        a, b, shared = overlaps(np.cumsum(self.vocab_a.lengths[ids_a]), np.cumsum(self.vocab_b.lengths[ids_b]))
        last_a, last_b = a[shared], b[shared]
        upto = np.searchsorted(last_a, np.cumsum(np.where(good, n_a, 0)))  # groups that end before a segment's end
        n = np.diff(upto, prepend=0)
        text, ends = written_groups(ids_a, ids_b, last_a, last_b)
        known = len(self.known)
        self.known.update(zip(names, range(known, known + len(names))))
        own = {"n_a": n_a, "n_b": n_b, "n_links": n, "n_text": np.diff(np.concatenate(([0], ends))[upto], prepend=0), "used": np.zeros(len(names))}
        for k, x in own.items():
            setattr(self, k, np.concatenate((getattr(self, k), x.astype(np.int32))))
        self.groups = np.concatenate((self.groups, text))
        self.links = np.concatenate((self.links, pairs.codes(ids_a[last_a], ids_b[last_b]).astype(np.int32)))
        self._place()

    def find(self, names: list[bytes], counts: np.ndarray, pairs: Pairs) -> np.ndarray:
        """The numbers of segments that stand ``counts`` times, aligned now if they weren't before."""
        new = [x for x in names if x not in self.known]
        if new:
            if len(self.known) + len(new) > MOST_SEGMENTS or len(self.groups) > MOST_BYTES:
                self.keep_most_used(names)
            for at in range(0, len(new), 1 << 16):
                self.add(new[at : at + (1 << 16)], pairs)
        found = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.used[found] += counts.astype(np.int32)
        return found


#: The decimal texts of small numbers, on end, for ``written_groups``.
_DECIMALS = Vocabulary([b"%d" % i for i in range(1 << 17)])


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` of all groups on end, and where each ends. A group has the tokens up to its last ones."""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    before_a, before_b = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(before_a, n_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(before_b, n_b)] = ids_b
    marks[last_a + before_a], marks[last_b + before_b] = ord("|"), ord(";")
    long = _DECIMALS.lengths[ids] + 1
    ends = np.cumsum(long)
    at = ragged(_DECIMALS.begins[ids], long)
    at[ends - 1] = 0
    text = _DECIMALS.data[at]
    text[ends - 1] = marks
    return text, ends[last_b + before_b]


def _same(vocab: Vocabulary, n: np.ndarray, ids: np.ndarray, names: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether the joined tokens of each segment are its bytes."""
    long = vocab.lengths[ids]
    edges = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate(([0], np.cumsum(long)))
    good = np.diff(total[edges]) == sizes
    if good.all():
        other = vocab.joined(ids) != np.frombuffer(b"".join(names), np.uint8)
        if not other.any():
            return good
        wrong = np.concatenate(([0], np.cumsum(other)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return wrong[ends[1:]] == wrong[ends[:-1]]
    for i in np.flatnonzero(good).tolist():
        good[i] = vocab.joined(ids[edges[i] : edges[i + 1]]).tobytes() == names[i]
    return good


_loaded: dict[tuple[str, str], tuple[Tokenizers, Pairs]] = {}


def loaded(path_a: str, path_b: str) -> tuple[Tokenizers, Pairs]:
    """The tokenizers of two files, kept for the worker's life."""
    if (path_a, path_b) not in _loaded:
        t = Tokenizers(path_a, path_b)
        _loaded[path_a, path_b] = t, Pairs(t.vocab_a, t.vocab_b)
    return _loaded[path_a, path_b]


def align_chunk(texts: pa.Array, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list[np.ndarray], list[np.ndarray]]:
    """For each text n_a, n_b, n_links, its groups as bytes, and its distinct link codes with how often each stands."""
    both, pairs = loaded(path_a, path_b)
    data, bounds = raw(texts)
    sizes = np.diff(bounds)
    spaced = np.insert(data, bounds[:-1][sizes > 0], 32)
    bounds = np.concatenate(([0], np.cumsum(sizes + (sizes > 0))))
    arr = binary_array(spaced, bounds)
    pieces, per_text = segments(arr) if both.cuts else (arr.filter(pa.array(sizes > 0)), (sizes > 0).astype(np.int64))
    edges = np.concatenate(([0], np.cumsum(per_text)))
    if len(pieces):
        found = pieces.dictionary_encode()
        own = np.asarray(found.indices)
        at = both.find(found.dictionary.to_pylist(), np.bincount(own), pairs)[own]
    else:
        at = np.zeros(0, np.int64)
    bad = np.concatenate(([0], np.cumsum(both.n_a[at] < 0)))
    bad = bad[edges[1:]] > bad[edges[:-1]]  # a segment doesn't give its bytes again, so neither does the text
    upto = lambda x: np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))[edges]
    n_a, n_b, n_links = (np.where(bad, 0, np.diff(upto(x))) for x in (both.n_a, both.n_b, both.n_links))
    written, place = memoryview(both.groups[ragged(both.text_at[at], both.n_text[at])]), upto(both.n_text).tolist()
    groups = [b"" if b else written[x : max(x, y - 1)] for b, x, y in zip(bad.tolist(), place, place[1:])]
    kept = ~np.repeat(bad, per_text)
    links = both.links[ragged(both.links_at[at[kept]], both.n_links[at[kept]])].astype(np.int64)
    keys, counts = np.unique(np.repeat(np.arange(len(texts)), n_links) * len(pairs) + links, return_counts=True)
    cut = np.searchsorted(keys, np.arange(1, len(texts)) * len(pairs)) if len(texts) else []
    return n_a, n_b, n_links, groups, np.split((keys % max(1, len(pairs))).astype("<i4"), cut), np.split(counts.astype("<i4"), cut)


def _aligned(path_a: str, path_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in gathered(batches, "text", ALIGN_BYTES):
            n_a, n_b, n_links, groups, codes, counts = align_chunk(chunk.column("text"), path_a, path_b)
            marks = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, n_a.tolist())]
            bins = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (codes, counts)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(marks, pa.string()), *bins], ["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "codes", "counts"])

    return rows


ALIGNED = "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, codes binary, counts binary"


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All link codes and counts of a batch's rows, and where each row's begin."""
    codes, bounds = raw(batch.column("codes"))
    counts, _ = raw(batch.column("counts"))
    return codes.view("<i4"), counts.view("<i4"), bounds // 4


def _totals(n_pairs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            codes, counts, _ = _flat(batch)
            total += np.bincount(codes, weights=counts, minlength=n_pairs).astype(np.int64)  # exact: a batch has fewer than 2**53 links
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            own = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["code", "n"])

    return rows


def _rated(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = shared.value
        for batch in batches:
            codes, counts, bounds = _flat(batch)
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[bounds]) for x in (counts * best[codes], counts * total[codes])]
            keep = [batch.column(x) for x in ("doc_id", "n_a", "n_b", "n_links", "n_links")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x.astype(np.int64)) for x in sums), batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For documents (doc_id, text): n_a, n_b (tokens), n_groups, n_links (pairs
    that end together; each closes a group, so both are one number), n_best (links
    whose count in the corpus is the highest of their second id, ties included),
    count_sum (of the links' counts) and groups_sha256.

    Null and empty texts, and texts that a tokenizer's tokens don't give again byte
    by byte, have no tokens: zeros and an empty digest. Repeated rows count each;
    null ids stay; a text of any length is one row, whose distinct links are as many
    as the vocabularies allow at most; an empty table gives no row; other columns
    are left alone.

    Texts are tokenized once: what each holds is written as Parquet, and read for
    the sums of the corpus and for the documents' own. The sums are a row for each
    id pair (``Pairs``), so they go through the driver and out again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    where = f"{shared_dir(spark)}/aligned"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_aligned(path_a, path_b), ALIGNED).write.option("compression", "zstd").parquet(where)
    each = spark.read.schema(ALIGNED).parquet(where)
    _, pairs = loaded(path_a, path_b)
    found = each.select("codes", "counts").mapInArrow(_totals(len(pairs)), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(pairs), np.int64)
    total[np.asarray(found.column("code"))] = np.asarray(found.column("n"))
    most = np.zeros(pairs.width, np.int64)
    np.maximum.at(most, pairs.second(), total)
    best = (total == most[pairs.second()]).astype(np.int64)
    return each.mapInArrow(_rated(spark.sparkContext.broadcast((total, best))), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
