"""Whitening against exact fractions and a plain eigendecomposition."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotegrid.llm import entry, whitening


def plain(rows, most=4):
    whole = [(i, v) for i, v in rows if v]
    if not whole:
        return []
    sizes = Counter(len(v) for _, v in whole)
    dim = max(sizes, key=lambda d: (sizes[d], d))
    xs = [(i, tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in v)) for i, v in whole if len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    scatter = [[sum(y[i] * y[j] for y in centred) for j in range(dim)] for i in range(dim)]
    if not xs:
        return []
    v = np.array([[float(Fraction(t, n**3)) for t in r] for r in scatter])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in xs:
        y = [n * c - s for c, s in zip(x, sums)]
        d = sum(a * a for a in y)
        for k in range(min(most, dim)):
            w = sum(float(Fraction(y[j], n)) * u[j, k] for j in range(dim)) / math.sqrt(e[k]) if e[k] > 1e-12 * e[0] > 0 else None
            out.append((i, k + 1, n, d if d < 2**63 else None, w, e[k] / v.trace() if v.trace() > 0 else 0.0))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, r[1], r[3] or 0)


def same(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double")
    own = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = sorted([tuple(r) for r in whitening.whiten(df).collect()], key=order), sorted(plain(own), key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    sign = {}
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-12) and g[6] <= 1e-9
        assert (g[4] is None) == (w[4] is None)
        if w[4] and abs(w[4]) > 1e-9:
            assert sign.setdefault(g[1], np.sign(g[4] * w[4])) == np.sign(g[4] * w[4])
            assert abs(g[4]) == pytest.approx(abs(w[4]), rel=1e-6)
    return got


def cloud(scale=1.0):
    rng = np.random.default_rng(1)
    return [(i, [float(x) * scale for x in v]) for i, v in enumerate(rng.normal(size=(200, 6)) * np.arange(1, 7))]


def test_awkward_rows(spark):
    rows = cloud()
    rows += [rows[5], (5, rows[9][1]), (None, rows[6][1]), (900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [-0.0] * 6), (907, [0.0] * 6)]
    same(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [float("nan")])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 5.0]), (3, [1.0, 6.5])], [(1, [1e30, 2.0]), (2, [-1e30, 5.0]), (3, [2.0**54, 6.5])]])
def test_small_and_huge(spark, rows):
    same(spark, rows)


def test_exact_beyond_longs(spark):
    got = same(spark, cloud(1e9))
    assert any(r[3] is None for r in got)  # no long holds these


@settings(max_examples=100, deadline=None)
@given(st.integers(-(10**40), 10**40))
def test_remainders_give_the_number_again(x):
    mods = whitening.primes(2 * 10**40)
    assert whitening.remainder([x % p for p in mods], mods) == x


def test_packed_vectors_read_back():
    x = np.array([[0, -1, 127], [128, 0, 0], [1 << 31, -5, 0], [whitening.LEAST, whitening.MOST, 3], [0, -1, 127]])
    packed = whitening._pack(x)
    assert (whitening._unpack(packed, 3) == x).all()
    assert packed[0] == packed[4] and len(packed[0].as_py()) == 4


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = entry.op11_whitening(spark, sf_dir)
    assert got.columns == whitening.WHITENED
    assert got.count() == 4 * table.where("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))").count()
    assert got.select(F.max("identity_error")).first()[0] <= 1e-9
