"""The methods' own results against plain versions: what a mix takes, what quality keeps, scores and license spans."""

from collections import Counter

import brute
import fixtures
import numpy as np
import pyarrow as pa
import pytest

from quotegrid.llm import licenses, mixing, quality, secret_ledger, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA).repartition(3)


def test_mix_taken(spark, docs):
    """Every document's words and target, by dealing blocks one after another and writing the shards' words out."""
    rows = [(r[0], r[3], len(brute.words(r[1]))) for r in fixtures.rows()]
    for options in ({}, {"shard_words": 700, "max_shards": 40, "block": 7, "seed": 5}):
        got = mixing.mix(docs, **options).collect()
        plain = {"block": mixing.BLOCK_WORDS, "seed": 17, "shard_words": mixing.SHARD_WORDS, "max_shards": mixing.MAX_SHARDS, **options}
        want, shards, targets = brute.mix_taken(rows, repeats=mixing.MAX_REPEATS, **plain)
        taken = Counter()
        for r in got:
            taken[r.doc_id, r.size] += r.taken
        assert taken == want
        assert {r.source: r.target for r in got} == pytest.approx(targets)
        for key, (rounds, n, picked) in shards.items():
            assert 0 <= picked <= n and 0 <= rounds <= mixing.MAX_REPEATS, key


def test_seats_are_the_highest_quotients():
    """Against seats dealt one after another, with ties, zero votes and bounds."""
    rng = np.random.default_rng(11)
    for _ in range(400):
        n = int(rng.integers(1, 9))
        votes = [int(v) for v in rng.choice([0, 1, 2, 3, 3, 5, 40, 1000], n)]
        seats = int(rng.integers(0, 60))
        most = [int(m) for m in rng.integers(0, 30, n)]
        assert mixing.sainte_lague(votes, seats, most) == brute.highest_quotients(votes, seats, most), (votes, seats, most)


def test_shards_grow_with_the_words(spark):
    rows = [(i, "big" if i % 10 else "small", "w " * 50) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    stream = mixing._stream(df.selectExpr("doc_id", "source", "50L as size", "doc_id as row"), (1, 1), 3, 16, 500, 1000, 3)
    assert {r.source: r.shards for r in stream.select("source", "shards").distinct().collect()} == {"big": 36, "small": 4}
    few = mixing._stream(df.selectExpr("doc_id", "source", "50L as size", "doc_id as row"), (1, 1), 3, 16, 500, 10, 3)
    assert {r.source: r.shards for r in few.select("source", "shards").distinct().collect()} == {"big": 9, "small": 1}


@pytest.mark.parametrize("scale", [None, "sf0.01"])
def test_quality_kept(spark, docs, scale):
    df = docs if scale is None else spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = [r.asDict() for r in quality.grade(df).collect()]
    assert [r["kept"] for r in rows] == brute.quality_kept(rows, quality.RULES)


@pytest.mark.parametrize(
    "alarm,recall",
    [([0.01, 0.005, 0.02, 0.01, 0.015], [0.9, 0.5, 0.6, 0.3, 0.7]), ([0.05, 0.1, 0.02, 0.08, 0.03], [0.9, 0.8, 0.6, 0.7, 0.85]), ([0.002, 0.15, 0.06, 0.03, 0.01], [0.6, 0.9, 0.75, 0.5, 0.8])],
)
def test_em_follows_planted_accuracies(alarm, recall):
    """At the shipped settings, rules of different accuracies get estimates of their own, far from the prior's where they are."""
    rnd = np.random.default_rng(5)
    true, codes = rnd.random(40_000) < 0.8, np.zeros(40_000, int)
    for k in range(5):
        against = rnd.random(len(true)) < np.where(true, alarm[k], recall[k])
        codes += np.where(rnd.random(len(true)) < 0.9, np.where(against, 2, 1), 0) * 3**k
    share, good, bad = quality.fit(list(Counter(codes.tolist()).items()), 5)
    assert share == pytest.approx(0.8, abs=0.02)
    assert 1 - good == pytest.approx(alarm, abs=0.01) and bad == pytest.approx(recall, abs=0.03)


def test_toxicity_scores(spark, docs):
    sf = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    trained = toxicity.train(real, spark.read.parquet(f"{sf}/labels.parquet"))
    made = toxicity.Model({"w7": 4.0, "edited": 2.0, "idiot": 3.0, "worthless": 2.5}, {"w11": 1.5, "naï": 2.0}, (-1.0, 1.0, 0.5, 0.7, -0.4, 0.2))
    assert trained.terms
    for model, df in ((made, docs), (trained, docs), (trained, real.where("doc_id % 20 = 0"))):
        rows = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, round(brute.toxicity_score(r.text, model, toxicity.EDGE, toxicity.CONTEXT, (toxicity.REPORTING, toxicity.ADDRESS, toxicity.QUOTES)), 9)) for r in rows)
        assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.scores(df, model).collect()) == want


def test_toxicity_without_rows(spark, docs):
    """No labels, no documents, labels without values, and ids that repeat."""
    kinds = "doc_id long, quality int, toxic int"
    none = toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1, 1)], kinds))
    assert not none.terms and len({r.score for r in toxicity.scores(docs, none).collect()}) == 1
    nulls = spark.createDataFrame([(None, 1, 1), (1, 1, None), (3, 1, 1), (3, 1, 0), (5, None, 0), (5, None, 0)], kinds)
    model = toxicity.train(docs, nulls)
    assert all(0 <= r.score <= 1 for r in toxicity.scores(docs, model).collect())
    assert toxicity.without_toxic(docs.limit(0), model).collect() == []


def test_license_spans(spark):
    templates = dict(licenses.TEMPLATES)
    bsd = templates["bsd"].split()
    edited = [*bsd[:20], "ALTERED", *bsd[21:46], "CHANGED", "TWICE", *bsd[48:]]
    texts = [t for _, t in licenses.TEMPLATES] + [" ".join(edited), " ".join(bsd[:30] * 2), "intro " * 20 + templates["gpl"] + " outro", templates["mit"][:200] + " and " + templates["isc"], "", None, "no license here at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        want = brute.license_spans(texts[r.doc_id], licenses.TEMPLATES, licenses.LEAST_RUN, licenses.MOST_GAP)
        labels = {licenses.TEMPLATES[k][0] for k, *_ , share in want if share >= licenses.COVERED} | set(filter(None, brute.license_base(texts[r.doc_id])[4].split(",")))
        assert sorted((s.label, s.start, s.stop, round(s.covered, 9)) for s in r.spans) == sorted((licenses.TEMPLATES[k][0], a, b, round(c, 9)) for k, a, b, c in want), r.doc_id
        assert r.labels == ",".join(sorted(labels))
        if r.doc_id == len(licenses.TEMPLATES):
            assert "bsd" in r.labels  # a repeated passage with edits around it is put where it goes on


def test_secrets_many_matches(spark):
    """Places stay right over many runs of matches, and the time grows with the text."""
    import time

    text = "".join(f"password={'x' * (8 + i % 5)} {'short' if i % 3 else 'token=ab'} é" for i in range(3000))
    df = spark.createDataFrame([(0, text), (1, text[:5000])], "doc_id long, text string")
    for r in secret_ledger.digest(secret_ledger.findings(df)[0]).collect():
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (r.doc_id, *brute.secret_base(text if r.doc_id == 0 else text[:5000])[:4])
    long = spark.createDataFrame([(0, "password=abcdefghij " * 16_000)], "doc_id long, text string")
    began = time.perf_counter()
    assert secret_ledger.digest(secret_ledger.findings(long)[0]).first().n_assign == 16_000
    assert time.perf_counter() - began < 60


def test_scorer_reads_chunks_alike():
    model = toxicity.Model({"idiot": 3.0}, {}, (-1.0, 1.0, 0.5, 0.7, -0.4, 0.2))
    scorer = toxicity.Scorer(model.terms, model.stems)
    texts = ["you idiot", None, "", "an idiott said", "“idiot” is a word"]
    assert model.score(scorer.features(pa.array(texts))).tolist() == [model.score(scorer.features(pa.array([t], pa.string())))[0] for t in texts]


