"""Histories dealt by performance, caches by changes, and the second scorer."""

import random

from pyspark.sql import functions as F

from quotegrid.functions import similarity
from quotegrid.operators import history as H
from quotegrid.plans import QUERIES
from quotegrid.sources import catalog as C

ROWS = "show_id string, date string, time string, t string, seq long, min double"


def log(n, seed):
    rnd = random.Random(seed)
    return [(str(rnd.randrange(4)) if rnd.random() < 0.6 else "hot", f"2026-01-0{rnd.randrange(1, 4)}", "19:30", "r", i, float(rnd.randrange(3))) for i in range(n)]


def moved(plan: str, what: str) -> bool:
    """Whether the branch of a plan that reads ``what`` has an exchange above it."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if what in x)
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    for i in range(at - 1, -1, -1):
        if depth(lines[i]) < depth(lines[at]):
            at = i
            if "Join" in lines[i]:
                return False
            if "Exchange" in lines[i]:
                return True
    return False


def test_as_of_without_moving_the_history(spark, tmp_path):
    rows, rnd = log(400, 1), random.Random(2)
    asks = [(*rnd.choice(rows)[:3], rnd.randrange(-5, 405)) for _ in range(300)] + [("none", "2026-01-01", "19:30", 7)]
    table = H.save_by_performance(spark.createDataFrame(rows, ROWS), "history_test_a", 4, str(tmp_path / "a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = H.as_of(table, spark.createDataFrame(asks, "show_id string, date string, time string, at long"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        decided = H.decide(table, spark.createDataFrame(log(20, 3), ROWS).drop("seq"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not moved(plan, "history_test_a") and not moved(decided, "history_test_a") and plan.count("Exchange") == 1 and decided.count("Exchange") == 1
    want = []
    for a in asks:
        before = [r for r in rows if r[:3] == a[:3] and r[4] <= a[3]]
        want.append((*a, *((before[-1][3], before[-1][4], before[-1][5]) if before else (None, None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_appending_keeps_the_buckets(spark, tmp_path):
    name = "history_test_b"
    H.save_by_performance(spark.createDataFrame(log(50, 4), ROWS), name, 4, str(tmp_path / "b"))
    plain = spark.createDataFrame(log(50, 4), ROWS)
    for i in range(3):
        snap = spark.createDataFrame(log(30, 10 + i), ROWS).groupBy(*H.KEY).agg(F.max("min").alias("min")).withColumn("t", F.lit(f"r{i}"))
        got, plain = H.append_to(name, snap, 4), H.append(plain, snap)
        assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    again = H.append_to(name, snap, 4)
    assert again.count() == plain.count()  # a snapshot that comes twice adds nothing


def test_cache_by_changes(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "key string, value long, stored_at timestamp_ntz"
    rnd, want, sizes = random.Random(7), {}, []
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    assert C.load_changes(spark, path, schema).collect() == []
    for i in range(4):
        fresh = {f"k{rnd.randrange(30)}": rnd.randrange(3) for _ in range(20)}
        gone = [f"k{rnd.randrange(30)}" for _ in range(3)]
        df = spark.createDataFrame(list(fresh.items()), "key string, value long").withColumn("stored_at", stamp)
        changed = C.changed_entries(C.load_changes(spark, path, schema), df)
        sizes.append((changed.count(), sum(want.get(k) != v for k, v in fresh.items())))
        C.save_changes(changed, path)
        C.save_changes(df.limit(0), path, spark.createDataFrame([(k,) for k in gone], "key string"))
        want = {k: v for k, v in {**want, **fresh}.items() if k not in gone}
        assert {r.key: r.value for r in C.load_changes(spark, path, schema).collect()} == want
        if i == 2:
            C.compact_changes(spark, path, schema, F.col("value") > 0)
            want = {k: v for k, v in want.items() if v > 0}
            assert len(C.run_ids(spark, path)) == 1 and {r.key: r.value for r in C.load_changes(spark, path, schema).collect()} == want
    assert all(a == b for a, b in sizes)  # a save writes what changed, nothing else


def test_both_scores(spark, sf_dir):
    rows = QUERIES["title_scores"](spark, sf_dir).collect()
    assert rows and all(r.score == similarity.score(r.title_a, r.title_b) and r.other == similarity.difflib_token_set_ratio(r.title_a, r.title_b) for r in rows)
