import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotegrid.functions import similarity
from quotegrid.functions.registry import FUZZY_AUTO, FUZZY_REVIEW, SOURCE_PRIORITY
from quotegrid.operators import checks as Q
from quotegrid.operators import history as H
from quotegrid.operators import merge as M
from quotegrid.operators import offers as O
from quotegrid.operators import resolve as R
from quotegrid.operators import shows as S
from quotegrid.operators import verify as V

DAY = datetime.date
OFFER = "show_id long, show_ord long, date date, time string, source string, source_ord int, price_from double, price_to double, currency string, book_url string, available boolean"


@pytest.fixture(scope="module")
def offers(spark):
    d = DAY(2024, 1, 10)
    rows = [
        (1, 1, d, "19:30", "olt", 0, 20.0, None, "GBP", "u", True), (1, 1, d, "19:30", "ttd", 4, 20.0, None, "GBP", None, None),  # a tie: the first source wins
        (1, 1, d, "14:30", "olt", 0, 0.0, None, "GBP", "u", True), (1, 1, d, "14:30", "ttd", 4, 30.0, 60.0, "GBP", "u", True),  # 0 is unknown
        (2, 2, d, "19:30", "olt", 0, 10.0, None, "GBP", "u", False), (2, 2, d, "19:30", "ttd", 4, 15.0, 12.0, "GBP", "u", True),  # the cheaper one isn't available
        (3, 3, d, "19:30", "olt", 0, None, None, "GBP", "u", None), (3, 3, DAY(2024, 1, 9), "19:30", "olt", 0, 5.0, None, "GBP", "u", True),
        (4, 4, DAY(2024, 2, 20), "19:30", "olt", 0, 50.0, None, "GBP", "u", True),
    ]
    return spark.createDataFrame(rows, OFFER)


def test_effective(offers):
    got = {(r.show_id, str(r.date), r.time): (r.seller, r.price, r.seller_count) for r in O.effective(offers).collect()}
    assert got == {(1, "2024-01-10", "19:30"): ("olt", 20.0, 2), (1, "2024-01-10", "14:30"): ("ttd", 30.0, 1), (2, "2024-01-10", "19:30"): ("ttd", 15.0, 1), (3, "2024-01-09", "19:30"): ("olt", 5.0, 1), (4, "2024-02-20", "19:30"): ("olt", 50.0, 1)}


def test_order_does_not_matter(offers):
    eff = O.effective(offers)
    a = [O.week_days(eff, DAY(2024, 1, 10)), O.week_best(eff, DAY(2024, 1, 10)), S.widest_spreads(offers, DAY(2024, 1, 10)), S.seller_wins(offers)]
    shuffled = offers.orderBy(F.rand(3)).repartition(3)
    eff = O.effective(shuffled)
    b = [O.week_days(eff, DAY(2024, 1, 10)), O.week_best(eff, DAY(2024, 1, 10)), S.widest_spreads(shuffled, DAY(2024, 1, 10)), S.seller_wins(shuffled)]
    for x, y in zip(a, b):
        assert Counter(map(tuple, x.collect())) == Counter(map(tuple, y.collect()))


def test_availability_counts_where_it_should(offers):
    spread = S.widest_spreads(offers, DAY(2024, 1, 10)).collect()
    assert [(r.show_id, r.cheap_price, r.dear_price) for r in spread] == [(2, 10.0, 15.0)]  # availability is ignored here
    board = {(r.show_id, r.source): r.cheapest_count for r in S.scoreboard(offers).collect()}
    assert board[1, "olt"] == 1 and board[1, "ttd"] == 2  # ties count for both


def test_empty_tables(spark):
    none = spark.createDataFrame([], OFFER)
    eff = O.effective(none)
    assert O.week_days(eff, DAY(2024, 1, 10)).count() == 7 and all(r.bucket == 5 for r in O.week_days(eff, DAY(2024, 1, 10)).collect())
    assert O.best_nights(eff, DAY(2024, 1, 10)).count() == 0 and O.price_tiers(eff, DAY(2024, 1, 10)).count() == 4
    assert O.weekday_distribution(eff, DAY(2024, 1, 10)).count() == 7 and O.matinee_weeks(eff, none, DAY(2024, 1, 10)).count() == 1
    assert O.cheapest_weeknight(eff, DAY(2024, 1, 10)).count() == 0 and S.widest_spreads(none, DAY(2024, 1, 10)).count() == 0


# --- checked prices


def test_price_choice(spark):
    cols = "rec_id long, raw_ord long, date string, time string, price double, currency string, availability string, book_url string, verified_min_price double, verified_price_source string, verified_book_url string, seat_price_source string, seat_min_price double, seat_max_price double, seat_status string"
    base = (1, 0, "2026-01-01", "7:30", 20.0, "GBP", "x/InStock", "b")
    rows = [
        (*base, None, None, None, None, None, None, None), (*base, 18.0, "ttd_calendar", "v", None, None, None, None), (*base, None, "not_in_calendar", "", None, None, None, None),
        (*base, 18.0, "ttd_calendar", None, "fetch_failed", None, None, "result_code=-1"), (*base, 18.0, "ttd_calendar", None, "no_legend", None, None, "result_code=-1"), (*base, 18.0, "ttd_calendar", None, "seat_plan", 25.0, 40.0, None),
    ]
    got = [(r.price_from, r.price_to, r.available, r.book_url, r.time) for r in V.project(spark.createDataFrame(rows, cols), "ttd").collect()]
    assert got == [(20.0, None, True, "b", "07:30"), (18.0, None, True, "v", "07:30"), (None, None, True, "b", "07:30"), (None, None, True, "b", "07:30"), (18.0, None, True, "b", "07:30"), (25.0, 40.0, True, "b", "07:30")]
    love = spark.createDataFrame([(1, 0, "d", "t", 0.0, 12.0, "GBP", "", "o", None, 3), (1, 1, "d", "t", 9.0, 12.0, "GBP", "b", "o", "SoldOut", 3), (1, 2, "d", "t", None, 0.0, None, None, None, "", None)], "rec_id long, raw_ord long, date string, time string, min_combined_price double, price double, currency string, book_url string, offer_url string, availability string, max_seats int")
    assert [(r.price_from, r.book_url, r.available) for r in V.project(love, "lovetheatre").orderBy("raw_ord").collect()] == [(12.0, "o", True), (9.0, "b", False), (None, None, None)]
    assert V.union_of({"lovetheatre": love}).count() == 2  # a row without anything to offer goes


def test_bands_and_suspects(spark):
    df = spark.createDataFrame([([(10.0, 0), (20.0, 2), (15.0, 1)], 9.0, 5), ([(10.0, None)], 9.0, None), ([(10.0, 0)], 9.0, 5), ([(10.0, 3)], 9.0, 0), (None, 9.0, None)], "bands array<struct<price_value: double, seats_available: int>>, low double, seats int")
    assert [r[0] for r in df.select(V.band_low_price(F.col("bands"), F.col("low"), F.col("seats"))).collect()] == [15.0, 9.0, None, None, 9.0]
    s = spark.createDataFrame([(15.0, 20.0, 15.0), (20.0, 200.0, 20.0), (50.0, 60.0, 20.0), (20.0, 30.0, 20.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in s.select(V.price_suspect(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["low_floor", "wide_ratio", "high_outlier", None, None]
    n = spark.createDataFrame([(DAY(2024, 1, 12), [(10.0, 2), (20.0, 9)]), (DAY(2024, 1, 12), [(10.0, 0), (20.0, 9)]), (DAY(2024, 3, 1), [(10.0, 1)])], "d date, bands array<struct<price_value: double, seats_available: int>>")
    assert [r[0] for r in n.select(V.scarce_suspect(F.col("d"), F.col("bands"), DAY(2024, 1, 10))).collect()] == [True, False, False]
    a = spark.createDataFrame([(10.0, 10.5), (10.0, 10.6), (10.0, None)], "a double, b double")
    assert [r[0] for r in a.select(V.agrees(F.col("a"), F.col("b"))).collect()] == [True, False, None]


def test_calendar_and_removal(spark):
    perfs = spark.createDataFrame([(1, DAY(2026, 5, 1), "19:00"), (1, DAY(2026, 6, 1), "19:00"), (1, DAY(2026, 7, 1), "19:00")], "id int, date date, time string")
    cal = spark.createDataFrame([(DAY(2026, 5, 1), "19:00", 20.0, 0), (DAY(2026, 5, 1), "19:00", 22.0, 1)], "date date, time string, price double, pos int")
    failed = spark.createDataFrame([(2026, 6)], "year int, month int")
    got = {r.date.month: (r.verified_price_source, r.calendar_price) for r in V.calendar_check(perfs, cal, failed).collect()}
    assert got == {5: ("ttd_calendar", 22.0), 6: ("fetch_failed", None), 7: ("not_in_calendar", None)}
    kind = "perf_id string, date date, price_source string, max_seats int, availability string"
    old = spark.createDataFrame([("a", DAY(2026, 5, 1), "calendar_api", 3, "x"), ("b", DAY(2026, 5, 1), "jsonld_only", 3, "x")], kind)
    new = spark.createDataFrame([("a", DAY(2026, 5, 1), "jsonld_only", 3, "x"), ("b", DAY(2026, 5, 1), "jsonld_only", 3, "x")], kind)
    assert {r.perf_id: (r.max_seats, r.removed) for r in V.removed(old, new, DAY(2026, 4, 28), 14).collect()} == {"a": (0, True), "b": (3, False)}
    assert not any(r.removed for r in V.removed(old, new, DAY(2026, 4, 28), 14, fetch_ok=False).collect())


# --- merges


def test_merges(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, u string")
    right = spark.createDataFrame([(1, "y"), (3, "z")], "k int, u string")
    assert {tuple(r) for r in M.fill_from(left, right, ["k"], ["u"]).select("k", "v", "u", "side").collect()} == {(1, "a", "y", "both"), (2, "b", "x", "left"), (3, None, "z", "right")}
    p = M.prefer([spark.createDataFrame([(1, "l"), (None, "l")], "k int, v string"), spark.createDataFrame([(1, "r"), (2, "r"), (None, "r")], "k int, v string")], ["k"])
    assert Counter((r.k, r.v) for r in p.collect()) == Counter([(1, "l"), (2, "r"), (None, "l"), (None, "r")])
    perfs = spark.createDataFrame([("d", "t", "http://x/shows/seats/a/0"), ("d", "u", "http://x/shows/seats/a/0"), ("d", "t", "http://x/other/0")], "date string, time string, book_url string")
    ids = spark.createDataFrame([("d", "t", 55)], "date string, time string, perf_id int")
    assert Counter(r.book_url for r in M.patch_urls(perfs, ids).collect()) == Counter(["http://x/shows/seats/a/55", "http://x/shows/seats/a/0", "http://x/other/0"])
    z = spark.createDataFrame([([1, 2, 3], ["a"])], "a array<int>, b array<string>").select(M.zipped(F.col("a"), F.col("b")).alias("z")).first().z
    assert [tuple(x) for x in z] == [(1, "a"), (2, None), (3, None)]
    assert M.backfill(left, right, "k", "u").where("k = 1").first().u == "y"
    deals = spark.createDataFrame([(1, "t1"), (2, "t1"), (1, "none")], "show_id int, tag string")
    tags = spark.createDataFrame([("t1", "d1")], "tag string, date string")
    day = spark.createDataFrame([(1, "d1", "19:00", 5.0), (1, "d1", "14:00", 4.0)], "show_id int, date string, time string, price double")
    found, ghosts = M.deals_by_date(deals, tags, day)
    assert {r.show_id: [p.time for p in r.perfs] for r in found.collect()} == {1: ["14:00", "19:00"], 2: []} and [r.show_id for r in ghosts.collect()] == [2]


def test_unify(spark):
    rows = [(1, "d", "t", "olt", 0, 0, 30.0, None, "GBP", None, None), (1, "d", "t", "olt", 0, 1, 25.0, None, "GBP", None, False), (1, "d", "t", "ttd", 4, 0, 40.0, 35.0, "", None, None), (1, "d", "u", "ttd", 4, 0, 7.0, None, None, None, None)]
    got = {r.time: tuple(r)[3:] for r in M.unify(spark.createDataFrame(rows, "show_id int, date string, time string, source string, source_ord int, raw_ord int, price_from double, price_to double, currency string, book_url string, available boolean")).collect()}
    assert got == {"t": (25.0, 35.0, "GBP", False, 2), "u": (7.0, 7.0, None, None, 1)}


# --- history


def test_history(spark):
    snap = "show_id string, date string, time string, t string, min double, max double, currency string, any_available boolean, sources array<struct<source: string, price_from: double, price_to: double, available: boolean>>"
    src = [("olt", 5.0, None, None)]
    s1 = spark.createDataFrame([("s", "2024-02-01", "19:00", "r1", 5.0, None, "GBP", None, src), ("s", "2024-01-01", "19:00", "r1", 7.0, None, "GBP", None, src), ("gone", "2024-02-01", "19:00", "r1", 1.0, None, None, None, [])], snap)
    h = H.append(spark.createDataFrame([], H.SCHEMA), s1)
    assert h.count() == 3 and H.append(h, s1).count() == 3  # replay
    s2 = s1.withColumn("t", F.lit("r2"))
    assert H.append(h, s2).count() == 3  # nothing but the stamp differs
    s3 = s2.withColumn("min", F.when(F.col("date") == "2024-02-01", 4.0).otherwise(F.col("min")))
    h3 = H.append(h, s3)
    assert h3.count() == 5 and {r.seq for r in h3.where("show_id = 's' and date = '2024-02-01'").collect()} == {1, 2}
    s4 = s3.withColumn("sources", F.array(F.struct(F.lit("olt").alias("source"), F.lit(6.0).alias("price_from"), F.lit(None).cast("double").alias("price_to"), F.lit(True).alias("available"))))
    assert {r.fate for r in H.decide(h3, s4.withColumn("t", F.lit("r3"))).collect()} == {"append"}
    live = spark.createDataFrame([("s",)], "show_id string")
    assert [(r.show_id, r.date) for r in H.prune(h, live, DAY(2024, 1, 15)).collect()] == [("s", "2024-02-01")]
    assert H.prune(h.withColumn("date", F.lit("not a date")), live, DAY(2024, 1, 15)).count() == 0
    st = H.stats(h, s3, live, DAY(2024, 1, 15)).first()
    assert (st.appended, st.suppressed, st.pruned) == (2, 1, 3)
    prices = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("a", 3, 0.0), ("a", 4, 12.0), ("b", 1, 5.0)], "k string, seq long, min double")
    assert {r.k: (r.price, r.before, r.delta) for r in H.price_change(prices, ["k"]).collect()} == {"a": (12.0, 10.0, 2.0), "b": (5.0, None, None)}


# --- quality


def test_checks(spark, offers):
    got = {r.rule: r.n for r in Q.rule_counts(offers, Q.offer_rules(DAY(2024, 1, 10))).collect()}
    assert got == {"price_not_positive": 1, "price_too_high": 0, "min_above_max": 1, "year_out_of_range": 0, "no_book_url": 1, "no_source": 0}
    miss = {r.field: (r.share, r.exceeded) for r in Q.missing_shares(offers, {"book_url": 0.05, "price_to": 0.9}).collect()}
    assert miss["book_url"] == (pytest.approx(1 / 9), True) and miss["price_to"] == (pytest.approx(7 / 9), False)
    df = spark.createDataFrame([(0, 10), (7, 10), (8, 10), (10, 10)], "a int, b int")
    assert [r[0] for r in df.select(Q.coverage_level(F.col("a"), F.col("b"))).collect()] == ["critical", "error", "warning", "ok"]
    u = spark.createDataFrame([("http://a/", "http://a"), ("http://b", "http://c"), (None, "http://d")], "canon string, url string")
    assert tuple(Q.url_mismatch(u, "canon", "url").first()) == (2, 1, True)
    st = spark.createDataFrame([(0, 0, 0), (3, 1, 0), (3, 0, 3), (3, 0, 1)], "a int, b int, c int")
    assert [r[0] for r in st.select(Q.run_status(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["idle", "ok", "blocked", "drift"]


# --- resolution


def plain_fuzzy(records):
    """Clusters by exact keys, then best pairs first unless a source would come twice."""
    clusters = {}
    for r in records:
        clusters.setdefault((r["title_norm"], r["venue_norm"]), []).append(r)
    keys = sorted(clusters, key=lambda k: clusters[k][0]["rec_id"])
    ids = {k: clusters[k][0]["rec_id"] for k in keys}
    edges = [(similarity.score(a[0], b[0]), ids[a], ids[b], a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[1] == b[1]]
    up, src = {k: k for k in keys}, {k: {r["source"] for r in clusters[k]} for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    log = []
    for score, _, _, a, b in sorted((e for e in edges if e[0] >= FUZZY_REVIEW), key=lambda e: (-e[0], e[1], e[2])):
        ra, rb = root(a), root(b)
        if ra == rb:
            continue
        if score < FUZZY_AUTO:
            log.append((a[0], b[0], score, "review"))
        elif src[ra] & src[rb]:
            log.append((a[0], b[0], score, "blocked"))
        else:
            up[ra] = rb
            src[rb] |= src.pop(ra)
            log.append((a[0], b[0], score, "merged"))
    named = {}
    for k in keys:
        named[root(k)] = min(named.get(root(k), ids[k]), ids[k])
    return {r["rec_id"]: named[root((r["title_norm"], r["venue_norm"]))] for r in records}, Counter(log)


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(11)
    stems = ["the lion king", "hamilton", "les miserables", "wicked", "the phantom of the opera", "lion king tour", "hamilton an american musical", "phantom of the opera", "romeo and juliet", "romeo & juliet"]
    rows, used = [], set()
    for i in range(120):
        t, v, s = rnd.choice(stems), rnd.choice(["Old Vic", "Lyceum Theatre", "Gielgud", None]), rnd.choice(SOURCE_PRIORITY)
        t = rnd.choice([t, t.title(), t.upper() + "!", t + " extra", t + " live in london"])
        if (t, v, s) in used:
            continue
        used.add((t, v, s))
        rows.append((i, s, str(i), t if i % 23 else None, v, f"http://{i}", "d" * rnd.randrange(5)))
    return R.normalized(spark.createDataFrame(rows, "rec_id long, source string, source_id string, title_raw string, venue_raw string, url string, description string").repartition(3)).cache()


def test_fuzzy_merge(records):
    clustered, orphans = R.exact_clusters(records)
    rows = [r.asDict() for r in clustered.orderBy("rec_id").collect()]
    want, log = plain_fuzzy(rows)
    merged, got_log = R.fuzzy_merge(clustered)
    got = {r.rec_id: r.cluster_id for r in merged.collect()}
    assert Counter((r.title_a, r.title_b, r.score, r.fate) for r in got_log.collect()) == log and any(k[3] == "merged" for k in log) and any(k[3] == "blocked" for k in log)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want)
    for members in groups(got):  # no merge brings a source twice that the exact clusters didn't have
        exact = {r["rec_id"]: r["cluster_id"] for r in rows}
        if len({exact[m] for m in members}) > 1:
            src = Counter((r["source"], r["cluster_id"]) for r in rows if r["rec_id"] in members)
            assert len({s for s, _ in src}) == len(src)
    assert orphans.count() > 0


def test_rescue(records):
    clustered, orphans = R.exact_clusters(records)
    merged, log = R.rescue(clustered, orphans)
    rows, lost = [r.asDict() for r in clustered.collect()], [r.asDict() for r in orphans.orderBy("rec_id").collect()]
    held, size = {}, Counter(r["cluster_id"] for r in rows)
    for r in rows:
        held.setdefault(r["cluster_id"], set()).add(r["source"])
    titles = {(r["cluster_id"], r["title_norm"]) for r in rows}
    want = {}
    for o in lost:
        if not o["title_norm"]:
            want[o["rec_id"]] = "no_title_norm"
            continue
        best = {}
        for k, t in titles:
            if (s := similarity.score(o["title_norm"], t)) >= 90:
                best[k] = max(best.get(k, 0), s)
        ranked = sorted(best.items(), key=lambda x: (-x[1], -size[x[0]], x[0]))
        if not ranked:
            want[o["rec_id"]] = "no_match_above_threshold"
        elif len(ranked) > 1 and ranked[1][1] >= ranked[0][1] - 5:
            want[o["rec_id"]] = "blocked_ambiguous_match"
        elif o["source"] in held[ranked[0][0]]:
            want[o["rec_id"]] = "blocked_within_source_duplicate"
        else:
            want[o["rec_id"]] = "attached"
            held[ranked[0][0]].add(o["source"])
    assert {r.rec_id: r.status for r in log.collect()} == want
    assert merged.count() == len(rows) + sum(v == "attached" for v in want.values())


def test_rescue_takes_turns(spark):
    cols = "rec_id long, source string, title_norm string, venue_norm string, venue_canonical string, cluster_id long"
    clustered = spark.createDataFrame([(1, "olt", "hamilton musical", "v", "V", 1)], cols)
    orphans = spark.createDataFrame([(5, "ttd", "hamilton musical", None, None), (6, "ttd", "hamilton musical", None, None), (7, "olt", "hamilton musical", None, None), (8, "olt", "", None, None)], "rec_id long, source string, title_norm string, venue_norm string, venue_canonical string")
    got, log = R.rescue(clustered, orphans)
    assert {r.rec_id: r.status for r in log.collect()} == {5: "attached", 6: "blocked_within_source_duplicate", 7: "blocked_within_source_duplicate", 8: "no_title_norm"}
    assert got.where("rec_id = 5").first().venue_norm == "v"


def test_override(records):
    clustered, _ = R.exact_clusters(records)
    rows = clustered.orderBy("rec_id").collect()
    big = Counter(r.cluster_id for r in rows).most_common(1)[0][0]
    one = next(r for r in rows if r.cluster_id == big)
    others = [r for r in rows if r.cluster_id != big][:2]
    spec = lambda r: {"source": r.source, "source_id": r.source_id}
    rules = {"force_split": [{"record": spec(one)}, {"record": {"source": "olt", "source_id": "nope"}}], "force_merge": [{"records": [spec(others[0]), spec(others[1])]}, {"records": []}, {"records": [{"source": "x", "source_id": "y"}]}, {"records": [spec(others[0])]}, {"records": [spec(others[1])], "canonical_title": one.title_raw, "canonical_venue": one.venue_raw}]}
    out, log = R.override(clustered, rules)
    at = {r.rec_id: r.cluster_id for r in out.collect()}
    assert at[one.rec_id] == -one.rec_id - 1 and sum(v == at[one.rec_id] for v in at.values()) == 1
    assert [x["status"] for x in log] == ["applied", "record_not_found", "applied" if others[0].cluster_id != others[1].cluster_id else "no_op_already_merged", "needs_at_least_1_record", "no_records_found", "no_destination_cluster_found", "applied"]
    assert at[others[1].rec_id] == big
    assert R.override(clustered, {})[1] == []


def test_build_shows(spark, records):
    clustered, _ = R.exact_clusters(records)
    merged, _ = R.fuzzy_merge(clustered)
    perfs = merged.select("cluster_id").distinct().select("cluster_id", F.lit("d").alias("date"), F.lit("t").alias("time"), (F.col("cluster_id") * 1.0).alias("min_price"), F.lit(None).cast("double").alias("max_price"))
    shows = R.build_shows(merged, perfs).orderBy("show_ord").collect()
    assert [r.record_count for r in shows] == sorted((r.record_count for r in shows), reverse=True) and len({r.show_id for r in shows}) == len(shows)
    assert all(r.title and r.venue and r.performance_count == 1 for r in shows) and R.build_shows(merged, perfs.limit(0), 1).count() == 0
    rows = spark.createDataFrame([(1, 1, "olt", "MAMMA MIA!", "Novello Theatre", None), (1, 2, "ttd", "Mamma Mia! - The Novello Theatre", "Novello Theatre", " "), (1, 3, "seatplan", "MAMMA MIA!", "x", "abc"), (1, 4, "lovetheatre", "Mamma Mia!", None, "abd"), (2, 5, "olt", None, None, None)], "cluster_id long, rec_id long, source string, title_raw string, venue_canonical string, description string")
    assert {r.cluster_id: (r.title, r.title_source) for r in R.picked_titles(rows).collect()} == {1: ("Mamma Mia!", "lovetheatre")}
    assert {r.cluster_id: (r.description, r.description_source) for r in R.longest_texts(rows).collect()} == {1: ("abd", "lovetheatre")}
    assert {r.cluster_id: (r.venue, r.venue_source) for r in R.display_venues(rows).collect()} == {1: ("Novello Theatre", "registry"), 2: ("Unknown Venue", "first_source")}
    listed = R.source_rows(rows.withColumns({"source_id": F.col("rec_id").cast("string"), "venue_raw": F.col("venue_canonical")}))
    assert [r.source for r in listed.where("cluster_id = 1").orderBy("rank").collect()] == ["olt", "lovetheatre", "seatplan", "ttd"]
    lists = R.review(clustered, records.limit(2), R.fuzzy_merge(clustered)[1])
    assert set(lists) == {"orphans", "singletons", "pairs"} and lists["singletons"].count() > 0


def test_ranked_without_one_task(spark):
    import random

    from pyspark.sql import functions as F
    from quotegrid.operators.offers import ranked

    rnd = random.Random(2)
    rows = [(rnd.randrange(4), "".join(rnd.choice("abc") for _ in range(rnd.randrange(6))), i) for i in range(500)]
    df = spark.createDataFrame(rows, "n int, s string, i int").repartition(5)
    got = ranked(df, [-F.col("n"), F.substring("s", 1, 2)], [F.col("s"), F.col("i")]).collect()
    want = {r: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])))}
    assert {(r.n, r.s, r.i): r["rank"] for r in got} == want
    assert ranked(df.limit(0), [F.col("n")], [F.col("i")]).collect() == []
