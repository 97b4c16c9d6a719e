import hashlib
from collections import Counter, defaultdict

import brute
import fixtures
import pyarrow.parquet as pq
import pytest

from quotegrid.llm import mixing, simhash, substrings, tokenstore
from quotegrid.llm.entry import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in fixtures.rows()]


def real(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def empty(spark):
    return spark.createDataFrame([], fixtures.SCHEMA)


def test_mix(spark, docs):
    rows = fixtures.rows()
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.capped_targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], 3)))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    many = mixing.mix(docs, shard_words=500, max_shards=7).groupBy("source").sum("taken").collect()
    for s, t in many:
        assert abs(t - want[s]) <= 16 * mixing.BLOCK_WORDS
    assert mixing.mix(empty(spark)).collect() == []


def test_apportionment():
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    for seats in range(40):  # against one seat at a time
        votes, out = [340, 280, 160, 60, 15, 0], [0] * 6
        for _ in range(seats):
            i = max(range(6), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
            out[i] += 1
        assert mixing.sainte_lague(votes, seats) == out
    assert mixing.capped_targets([10, 1000, 1000], [1, 1, 1], 3) == [30, 990, 990]
    assert mixing.sainte_lague([1, 1], 10, [2, 100]) == [2, 8]


def test_substrings(spark, docs, plain):
    want = brute.substring_dedup(plain)
    hot_all = [r[0] for r in docs.select("text").mapInArrow(substrings._sample_anchors(50), "anchor long").distinct().collect()]
    assert sum(v[1] for v in want.values()) > 500
    for hot in (None, [], hot_all[::2]):
        got = substrings.remove_repeats(docs, hot=hot).collect()
        assert len(got) == len(plain)
        assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == Counter((d, *want[d, t]) for d, t in plain)
    assert substrings.remove_repeats(empty(spark)).collect() == []


def test_substrings_frequent_passage(spark):
    """A passage of most documents, which the sample finds, and one of just too few for it."""
    import random

    rnd = random.Random(5)
    passage, second = ([f"{k}{i}" for i in range(70)] for k in "pq")
    docs = []
    for i in range(4500):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(12)]
        docs.append((i, " ".join(own[:6] + (passage if i % 5 else []) + own[6:] + (second if i % 3 == 0 else []))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = brute.substring_dedup(docs)
    got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(df).collect()}
    assert got == {(d, *v) for (d, _), v in want.items()}


def test_substrings_real(spark, sf_dir):
    want = brute.substring_dedup(real(sf_dir))
    got = QUERIES["op2_substring_dedup"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == {(d, *v) for (d, _), v in want.items()}


def test_tokens(spark, docs, plain):
    path = tokenstore.write_store(docs, tokenizer_path())
    got = [tuple(r) for r in tokenstore.read_digests(spark, path).collect()]
    want = brute.token_rows(plain, tokenizer_path())
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in want)
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    ids = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda x: (x is None, x))
    assert {r.finding: r.n for r in tokenstore.verify(spark, path).collect()} == {"bad_chunks": 0, "double_chunks": 0, "missing_chunks": 0, "bad_parts": 0}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    back = Counter((r.doc_id, tuple(r.ids)) for r in tokenstore.read_ids(spark, path).collect())
    assert back == Counter((d, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for d, x in plain)
    bare = tokenstore.write_store(empty(spark), tokenizer_path())
    assert tokenstore.read_digests(spark, bare).collect() == []


def test_tokens_real(spark, sf_dir):
    got = QUERIES["op3_token_store"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == brute.token_rows(real(sf_dir), tokenizer_path())


@pytest.mark.parametrize("hashes,most", [(None, 60), (97, 1_000_000), (97, 80)])
def test_encoder_keeps_segments_apart(monkeypatch, hashes, most):
    """Small caches forget, and hashes that collide are told apart by the second one."""
    import random
    from types import SimpleNamespace

    import pyarrow as pa
    import xxhash
    from tokenizers import Tokenizer

    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(tokenstore, "CACHE_SEGMENTS", most)
    monkeypatch.setattr(tokenstore, "_encoders", {})
    if hashes:
        monkeypatch.setattr(tokenstore, "xxhash", SimpleNamespace(xxh64_intdigest=lambda b: real(b) % hashes))
    t, rnd = Tokenizer.from_file(tokenizer_path()), random.Random(1)
    for _ in range(25):
        texts = [" ".join(rnd.choice(["alpha", "beta", f"gamma{rnd.randrange(90)}", "é", "  x", "\n", "<|endoftext|>", "\u3000", "don't"]) for _ in range(rnd.randrange(40))) for _ in range(8)]
        ids, n = tokenstore.encode(pa.array(texts), tokenizer_path())
        at = 0
        for x, m in zip(texts, n.tolist()):
            assert ids[at : at + m].tolist() == t.encode(x, add_special_tokens=False).ids
            at += m


def test_merkle():
    for n in range(20):
        leaves, tree = [bytes([i]) for i in range(n)], tokenstore._Tree()
        for x in leaves:
            tree.add(x)
        assert tree.root() == tokenstore.merkle(leaves)


def test_crc():
    import zlib

    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc", b"defgh" * 100)):
        assert tokenstore.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_simhash(spark, docs, plain):
    want = Counter(brute.simhash_groups(plain))
    got = Counter((r.doc_id, f"{r.print % 2**64:016x}", r.component_id) for r in simhash.groups(docs).collect())
    assert got == want
    assert simhash.groups(empty(spark)).collect() == []


def test_simhash_real(spark, sf_dir):
    assert {tuple(r) for r in QUERIES["op5_simhash"](spark, sf_dir).collect()} == set(brute.simhash_groups(real(sf_dir)))


@pytest.mark.parametrize("large", [3, 100_000])
def test_links_against_all_pairs(spark, large):
    import random

    rnd = random.Random(3)
    xs = {rnd.getrandbits(64) for _ in range(150)}
    for x in list(xs)[:40]:
        for k in range(1, 8):
            for b in rnd.sample(range(64), k):
                x ^= 1 << b
            xs.add(x)
    dense = rnd.getrandbits(64)
    xs |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    xs = sorted(xs)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in xs], "print long")
    up = {x: x for x in xs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(xs):
        for y in xs[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                up[max(root(x), root(y))] = min(root(x), root(y))
    want = {x: root(x) for x in xs}
    up = {x: x for x in xs}
    for a, b in simhash.links(df, large=large).collect():
        a, b = a % 2**64, b % 2**64
        assert (a ^ b).bit_count() <= 64
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: root(x) for x in xs} == want
