"""Distinct counts that add up, searches by index, fetch attempts in batches and streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quotegrid.operators import attempts as T
from quotegrid.operators import counts as N
from quotegrid.operators import postings as P
from quotegrid.operators import spread
from quotegrid.plans import QUERIES
from quotegrid.streaming import attempts as S
from quotegrid.streaming import postings as S_P

START = datetime.datetime(2024, 1, 1, 12)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# --- distinct counts


def test_cube_counts_each_group_once(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.choice([None, -40000, -1, *range(0, 200000, 7919)])) for _ in range(3000)] + [("c", 9, None)]
    maps = N.bitmaps(spark.createDataFrame(rows, "x string, y int, id long"), ["x", "y"], "id")
    got = {(r.x, r.y, r.level): r.n for r in N.cube(maps, ["x", "y"]).collect()}
    want = {}
    for x, y, i in rows:
        for key in ((x, y, 0), (x, None, 1), (None, y, 2), (None, None, 3)):
            want.setdefault(key, set()).update(() if i is None else (i,))
    assert got == {k: len(v) for k, v in want.items()}
    assert got["c", 9, 0] == 0


def test_bitmaps_add_up_over_tables(spark):
    a = N.bitmaps(spark.range(0, 50000).select("id", F.lit("x").alias("g")), ["g"], "id")
    b = N.bitmaps(spark.range(40000, 90000).select("id", F.lit("x").alias("g")), ["g"], "id")
    assert N.distinct_ids(N.merged(a.unionByName(b), ["g"]), ["g"]).collect() == [("x", 90000)]
    assert N.distinct_ids(a.where("false"), ["g"]).count() == 0


@pytest.mark.parametrize("name", ["methodology", "coverage", "show_reach"])
def test_tables_are_read_once_and_rows_are_not_copied(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert sum("Relation" in line and "event_type" in line for line in plan.splitlines()) == 1
    if name != "show_reach":
        assert "Expand" not in plan  # there it is the bitmaps that are copied
    else:
        assert plan.index("Expand") < plan.index("bitmap_construct_agg")


# --- searches

TITLES = ["The Lion King", "Les Misérables", None, "", "lion", "LIONESS", "İstanbul", "a", "ab", "Kingdom of 𝔄bc", "the the the", "o' k", "lion"]


@pytest.fixture
def titles(spark, tmp_path):
    rows = [(i, t, TITLES[(i * 5) % len(TITLES)]) for i, t in enumerate(TITLES)] + [(100, "twice", "twice"), (100, "twice", "twice")]
    df = spark.createDataFrame(rows, "id int, title string, venue string")
    P.build(df, str(tmp_path / "index"), "id", ["title", "venue"])
    return df, rows, str(tmp_path / "index")


WORDS = ["lion", " KING ", "e", "th", "the", "𝔄b", "rab", "nothing here", "k", "o' k", "twice", "İst", "e l", "bul", "ki", "l"]


def found(df, words):
    w = F.lower(F.trim(F.lit(words)))
    held = F.lower(F.coalesce("title", F.lit(""))).contains(w) | F.lower(F.coalesce("venue", F.lit(""))).contains(w)
    return sorted(r.id for r in df.where(held).collect())


def test_lookup_finds_what_contains_finds(titles):
    df, _, path = titles
    for w in WORDS[:8]:
        assert sorted(r.id for r in P.lookup(df, path, "id", ["title", "venue"], w).collect()) == found(df, w), w
    assert P.lookup(df, path, "id", ["title", "venue"], "  ").count() == 0


def test_many_searches_at_once(spark, titles, monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 2)
    df, _, path = titles
    asked = [(f"{n}-{w}", w) for w in WORDS for n in range(2)] + [("null", None), ("blank", " ")]
    got = P.lookup_all(df, path, "id", ["title", "venue"], spark.createDataFrame(asked, "search_id string, words string"))
    assert got.columns == ["search_id", "id", "title", "venue"]
    want = sorted((f"{n}-{w}", i) for w in WORDS for i in found(df, w) for n in range(2))
    assert sorted((r.search_id, r.id) for r in got.collect()) == want


def test_a_search_reads_the_files_of_its_gram(spark, tmp_path):
    df = spark.range(20000).select("id", F.concat(F.lit("Common title "), F.sha2(F.col("id").cast("string"), 256)).alias("title"))
    path = str(tmp_path / "index")
    P.build(df, path, "id", ["title"], files=40)
    posted = spark.read.parquet(f"{path}/postings")
    rare = posted.where(F.col("gram") == "abc").select("key")
    n = len(rare.collect())
    read = rare._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert n and read * 10 < posted.count()
    got = P.lookup(df, path, "id", ["title"], "TITLE 5FECEB66")
    assert [r.id for r in got.collect()] == [0]
    # grams of every title are cut by key where a file ends inside them
    hot = posted.where("gram in ('com', 'omm', 'mmo', 'mon', 'tit', 'itl', 'tle')").select("gram", F.input_file_name().alias("file")).groupBy("gram").agg(F.countDistinct("file").alias("files"))
    assert hot.agg(F.max("files")).first()[0] > 1


def test_an_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id int, title string")
    path = str(tmp_path / "index")
    P.build(df, path, "id", ["title"])
    assert P.lookup(df, path, "id", ["title"], "abc").count() == 0
    assert P.lookup_all(df, path, "id", ["title"], spark.createDataFrame([("x", "abc"), ("y", "a")], "search_id string, words string")).count() == 0


def postings_of(spark, path):
    rows = P._read(spark, P._parts(spark, path), "postings").select("key", "gram").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def checked_searches(spark, rows, path):
    asked = spark.createDataFrame([(w, w) for w in WORDS], "search_id string, words string")
    many = P.lookup_all(rows, path, "id", ["title", "venue"], asked).collect()
    assert sorted((r.search_id, r.id) for r in many) == sorted((w, i) for w in WORDS for i in found(rows, w))
    for w in WORDS[:4]:
        assert sorted(r.id for r in P.lookup(rows, path, "id", ["title", "venue"], w).collect()) == found(rows, w), w


def test_an_index_is_kept_up_by_changes(spark, titles, tmp_path):
    df, rows, path = titles
    schema = df.schema
    changed = [(0, "The Sting", None), (2, "lion's king", "Thé"), (100, "twice", "kin"), (100, "twice", None), (200, "new lion", ""), (None, "nobody", "lion")]
    now = {r[0]: [r] for r in rows if r[0] not in (4, 100)}
    for r in changed:
        now[r[0]] = []
    for r in changed:
        now[r[0]].append(r)
    current = spark.createDataFrame([r for k in now if k is not None for r in now[k]], schema)
    before = postings_of(spark, path)
    for _ in range(2):  # a repeated attempt replaces its run
        P.add(spark.createDataFrame(changed, schema), path, "id", ["title", "venue"], removed=df.where("id = 4"), run="a")
    assert set(before) <= set(postings_of(spark, path)) and len(P._parts(spark, path)) == 2
    checked_searches(spark, current, path)
    # what an add writes is its own rows' postings, and no file of before is written again
    written = spark.read.parquet(f"{path}/run_id=a/postings")
    assert {r.key for r in written.select("key").distinct().collect()} == {0, 2, 100, 200, None}
    P.compact(spark, path)
    fresh = str(tmp_path / "fresh")
    P.build(current, fresh, "id", ["title", "venue"])
    nobody = sorted({g for g in P._read(spark, P._parts(spark, path), "postings").where("key is null").select("gram").collect()})
    assert nobody and sorted(x for x in postings_of(spark, path) if x[0] is not None) == postings_of(spark, fresh)
    checked_searches(spark, current, path)
    # the parts of before stay until the next compaction begins
    assert spark.read.parquet(f"{path}/postings").count() == len(before)
    P.add(current.where("id = 1").withColumn("title", F.lit("Kings")), path, "id", ["title", "venue"], run="b")
    P.compact(spark, path)
    assert P._parts(spark, path) == [f"{path}/run_id=b-whole"] and not P.catalog.exists(spark, f"{path}/postings")
    assert not any(g == "ser" for k, g in postings_of(spark, path) if k == 1)
    P.compact(spark, path)
    assert P.catalog.run_ids(spark, path) == ["b-whole"]


def test_adding_nothing(spark, titles):
    df, _, path = titles
    P.add(df.where("false"), path, "id", ["title", "venue"])
    P.add(df.where("id = 3").limit(0), path, "id", ["title", "venue"], removed=df.where("false"))
    checked_searches(spark, df, path)
    P.compact(spark, path)
    checked_searches(spark, df, path)


def test_an_index_follows_a_stream(spark, tmp_path):
    """Batches in order of their files; a key's last change of a batch counts, and compactions lie between."""
    kinds = "id int, title string, venue string, seq long, gone boolean"
    batches = [
        [(1, "lion", None, 1, None), (1, "The Lion", "x", 2, False), (2, "king", "ki", 3, None)],
        [(2, "king", None, 4, True), (3, "other", "e l", 5, None)],
        [(2, "the k", "twice", 6, None), (3, None, None, 8, True), (3, "again", "th", 7, None)],
    ]
    state = {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for r in sorted(rows, key=lambda r: r[3]):
            state[r[0]] = r
        stream = S_P.follow(spark.readStream.schema(kinds).json(str(tmp_path / "in")), str(tmp_path / "index"), "id", ["title", "venue"], str(tmp_path / "ck"), compact_every=1)
        stream.processAllAvailable()
        stream.stop()
        live = spark.createDataFrame([r[:3] for r in state.values() if not r[4]], "id int, title string, venue string")
        checked_searches(spark, live, str(tmp_path / "index"))
    assert P.catalog.run_ids(spark, str(tmp_path / "index"))[-1] == "0000000002-whole"
    assert {k for k, _ in postings_of(spark, str(tmp_path / "index"))} == {1, 2}


def test_pieces_of_long_texts(spark):
    df = spark.range(1).select(F.repeat(F.lit("abcdefgh "), 30000).alias("t"))
    assert len(df.select(P.grams(F.col("t"))).first()[0]) == 11


# --- attempts

POLICY = T.Policy(attempts=3, backoff=60, deadline=3600)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain_outcome(rows, now):
    """One key's outcome, read off in order."""
    rows = sorted((r for r in rows if r[1] is not None and r[0] is not None), key=lambda r: (r[1], r[0], r[2] is not None, r[2] or 0))
    upto = rows[0][1] + datetime.timedelta(seconds=POLICY.deadline)
    for n, t, s in rows:
        if t > upto:
            break
        end = "ok" if s is not None and 200 <= s < 300 else "refused" if s is not None and s not in POLICY.again else "exhausted" if n >= POLICY.attempts else None
        if end:
            return end, n, s
    n, t, s = rows[-1]
    return ("deadline" if now > upto else "pending"), n, s


def made_answers(seed, keys=40):
    rng = random.Random(seed)
    rows = [(f"k{k}", n, at(rng.randrange(0, 7200)), rng.choice([None, 200, 404, 429, 503, 503, 503, None])) for k in range(keys) for n in range(1, rng.randrange(2, 6))]
    return rows + rows[:5]


SCHEMA = "key string, attempt int, at timestamp_ntz, status int"


def test_outcomes_in_any_order(spark):
    rows = made_answers(3)
    now = at(5400)
    random.Random(1).shuffle(rows)
    got = {r.key: (r.outcome, r.attempt, r.status) for r in T.outcomes(spark.createDataFrame(rows, SCHEMA), F.lit(now).cast("timestamp_ntz"), policy=POLICY).collect()}
    want = {k: plain_outcome([r[1:] for r in rows if r[0] == k], now) for k in {r[0] for r in rows}}
    assert got == want
    assert len({o for o, _, _ in want.values()}) == 5


def test_outcomes_of_single_cases(spark):
    rows = [("again", 2, at(60), None), ("again", 1, at(0), 503), ("late", 1, at(0), 500), ("late", 2, at(3601), 200), ("no time", 1, None, 200), ("spent", 3, at(5), None), ("gone", 1, at(3), 410), (None, 1, at(0), 204)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_at_more", F.lit(1))
    out = {r.key: r for r in T.outcomes(df, F.lit(at(3600)).cast("timestamp_ntz"), policy=POLICY).collect()}
    assert set(out) == {"again", "late", "spent", "gone", None}
    assert (out["again"].outcome, out["again"].next_at, out["again"].reason) == ("pending", at(60 + 120), None)
    assert (out["late"].outcome, out["late"].attempt) == ("pending", 2)
    assert (out["spent"].outcome, out["spent"].reason) == ("exhausted", "no answer after 3 attempts")
    assert (out["gone"].outcome, out["gone"].reason, out["gone"].next_at) == ("refused", "HTTP 410", None)
    assert out[None].outcome == "ok"
    last = {r.key: r.reason for r in T.outcomes(df, F.lit(at(3700)).cast("timestamp_ntz"), policy=POLICY).collect()}
    assert last["again"] == "deadline, last no answer"
    assert T.outcomes(df.where("false"), F.lit(at(0)).cast("timestamp_ntz")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_gives_the_same_outcomes_in_any_order_of_batches(spark, tmp_path, seed):
    rows = made_answers(7, 15)
    random.Random(seed).shuffle(rows)
    parts = [rows[i::3] for i in range(3)] + [[("clock", 1, at(90 * 86400), 200)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={i}"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        answers = spark.readStream.schema("key string, attempt int, at timestamp, status int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
        out = S.follow(answers, "1 day", POLICY)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    finally:
        spark.conf.set(name, before)
    got = spark.read.parquet(str(tmp_path / "out"))
    ends = {r.key: (r.outcome, r.attempt, r.status) for r in got.where("outcome <> 'again'").collect()}
    want = {k: plain_outcome([r[1:] for r in rows if r[0] == k], at(60 * 86400)) for k in {r[0] for r in rows}}
    assert ends == want
    asks = got.where("outcome = 'again'").collect()
    assert all(r.due is not None and r.attempt >= 2 for r in asks)


# --- polls


def test_settled(spark):
    polls = [("a", 1, "loading"), ("a", 2, "from £20"), ("a", 3, "£20"), ("a", 4, "£20 or £20"), ("a", 5, "£30"), ("b", 1, "£10"), ("b", 2, "£12 £10"), ("c", 1, None), ("c", 2, "£900"), ("c", 3, "£900"), ("c", 4, "£900"), ("d", None, "£10"), ("e", 1, "£10"), ("e", 1, "£10"), ("e", 1, "£11")]
    got = {r.key: r for r in T.settled(spark.createDataFrame(polls, "key string, poll int, text string")).collect()}
    assert set(got) == set("abce")
    assert (got["a"].poll, got["a"].stable, got["a"].low, got["a"].note) == (4, True, 20.0, "chips")
    assert (got["b"].poll, got["b"].stable, got["b"].low, got["b"].high, got["b"].n_prices) == (2, False, 10.0, 12.0, 2)
    assert (got["c"].poll, got["c"].stable, got["c"].low, got["c"].note) == (4, False, None, "no prices in plausible range; saw 1 raw")
    assert (got["e"].low, got["e"].n_prices) == (10.0, 1)


def test_postings_of_a_small_file_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "TASK", 100)
    rows = spark.range(200).selectExpr("id", "concat('title ', id) AS title").coalesce(1)
    posted = P._posted(rows, "id", ["title"])
    assert posted.rdd.getNumPartitions() == 17  # 1,690 letters
    held = posted.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in held) < 500 and sum(r["count"] for r in held) == posted.distinct().count()
    path = str(tmp_path / "index")
    P.build(rows, path, "id", ["title"])
    P.add(rows.where("id < 9").withColumn("title", F.lit("other")), path, "id", ["title"], run="a")
    P.compact(spark, path)
    assert [r.id for r in P.lookup(rows.where("id > 8"), path, "id", ["title"], "title 19").orderBy("id").collect()] == [19, *range(190, 200)]
