"""Resolution at a distance: plans that don't grow with the chain, pairs found without loss, and work that is dealt."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quotegrid.functions import similarity
from quotegrid.operators import resolve as R
from quotegrid.operators import spread
from quotegrid.plans import QUERIES

VOCAB = ["lion", "king", "musical", "phantom", "opera", "hamlet", "a", "in", "london", "tour", "live", "extra", "rock", "rocky", "kings", "lions", "oper"]


def titles(n, seed, also=()):
    rnd = random.Random(seed)
    return sorted({" ".join([*also, *rnd.sample(VOCAB, rnd.randrange(1, 5))]) for _ in range(n)})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("exact_clusters", 5), ("fuzzy_clusters", 10), ("orphan_rescue", 10), ("unified_shows", 20)])
def test_plans_stay_small(spark, sf_dir, name, most):
    got = plan(QUERIES[name](spark, sf_dir))
    assert got.count("Exchange") <= most and "part.parquet" not in got  # it starts at a stage, not at the table


@pytest.mark.parametrize("hot_rows", [2048, 5])
@pytest.mark.parametrize("least", [0, 60, 75, 90])
def test_pairs_equal_all_pairs(spark, hot_rows, least):
    left, right = titles(60, 1), titles(60, 2, ["the"])
    df = lambda x: spark.createDataFrame([(t, t) for t in x], "id string, title string")
    got = {(r.a_title, r.b_title): r.score for r in R.scored_pairs(df(left), df(right), [], least, hot_rows).collect()}
    want = {(a, b): similarity.score(a, b) for a in left for b in right if a != b and similarity.gate(a, b) and similarity.score(a, b) >= least}
    assert got == want and want


def test_one_word_in_every_title(spark):
    """A short word that all titles have brings none of them together."""
    rnd = random.Random(3)
    rows = [(i, f"the {rnd.choice('abcdefgh')}{i} {rnd.choice('abcdefgh')}{i % 97}x") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, title string")
    found = R.title_tokens(df, 50)
    assert {r.tokens[-1] for r in found.collect()} == {"the"}
    pairs = R.candidates(found, found, [], 60, 50).where("a_id < b_id")
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if similarity.score(a[1], b[1]) >= 60}
    got = {(r.a_id, r.b_id) for r in pairs.collect()}
    assert want <= got and len(got) < 400 * 399 / 2 / 20


def test_common_word_is_dealt_over_tasks(spark):
    """With a long word that all titles share no task has over three times the median of its pairs."""
    rows = [(i, f"musical {i}") for i in range(600)]
    found = R.title_tokens(spark.createDataFrame(rows, "id long, title string"), 50)
    key = lambda x: found.select(F.col("id").alias(x), F.explode(R.title_keys(F.col("tokens"))).alias("key"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = spread.dealt_join(key("a").repartition(3), key("b").hint("merge"), ["key"], 50).where("a < b").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = sorted(r[1] for r in sizes)
    assert sum(sizes) == 600 * 599 / 2 and len(sizes) == 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 1), (7, 3), (3, 7), (7, 9)] + [(500, 501 + rnd.randrange(40)) for _ in range(60)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.label for r in spread.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if x != 1}
    assert spread.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_venue_merges_by_components(spark):
    """One venue, many small components: each is decided apart, and each by its best pairs."""
    rnd, rows = random.Random(9), []
    for i in range(200):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(4)]
        rows += [(3 * i + k, s, " ".join(words[: k + 2])) for k, s in enumerate(("olt", "ttd", "olt"))]
    records = spark.createDataFrame([(i, s, str(i), t, "v", "V", t, t) for i, s, t in rows], "rec_id long, source string, source_id string, title_norm string, venue_norm string, venue_canonical string, title_raw string, venue_raw string")
    clustered, _ = R.exact_clusters(records)
    merged, log = R.fuzzy_merge(clustered)
    groups = {}
    for r in merged.collect():
        groups.setdefault(r.cluster_id, set()).add(r.rec_id)
    assert len(groups) == 400 and all(len(g) <= 2 for g in groups.values())
    assert {r.fate: r["count"] for r in log.groupBy("fate").count().collect()} == {"merged": 200, "blocked": 400}
