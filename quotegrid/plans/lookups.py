"""Queries over distinct counts that add up, searches by index, and fetch attempts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attempts as T
from ..operators import counts as N
from ..operators import postings as P
from ..sources import adapters as A
from ..sources.session import scratch, stage
from .base import OFFERS, SEEN, SHOWS, query, with_

c = F.col

# --- distinct counts


@query(with_(SEEN) + "SELECT date, source, grouping(date, source) AS level, count(DISTINCT show_id) AS shows FROM seen GROUP BY CUBE (date, source)")
def show_reach(spark, sf_dir):
    """Distinct shows for each day and seller, each day, each seller, and all, in one pass."""
    return N.cube(N.bitmaps(A.observations(spark, sf_dir), ["date", "source"], "show_id"), ["date", "source"], "shows")


@query(with_(SEEN) + "SELECT date_trunc('week', date)::DATE AS week, source, count(DISTINCT show_id) AS shows FROM seen GROUP BY ALL")
def weekly_reach(spark, sf_dir):
    """Distinct shows of a week from the stored bitmaps of its days, those of each half of the month written apart."""
    seen = A.observations(spark, sf_dir)
    days = [stage(N.bitmaps(seen.where(half), ["date", "source"], "show_id")) for half in (F.dayofmonth("date") <= 15, F.dayofmonth("date") > 15)]
    weeks = days[0].unionByName(days[1]).withColumn("week", F.to_date(F.date_trunc("week", "date")))
    return N.distinct_ids(weeks, ["week", "source"], "shows")


@query(
    with_(OFFERS, SHOWS)
    + "SELECT venue, count(DISTINCT s.show_id) AS show_count, count(DISTINCT (o.show_id, date, time)) AS perf_count, count(*) AS offer_count, count(DISTINCT source) AS seller_count FROM offers o JOIN shows s ON o.show_id = s.show_id GROUP BY venue"
)
def venue_sellers(spark, sf_dir):
    """Performances, offers and distinct sellers of each venue, summed from its shows' facts."""
    nations = A.read(spark, sf_dir, "nation").select("n_nationkey", c("n_name").alias("venue"))
    homes = A.read(spark, sf_dir, "customer").join(F.broadcast(nations), c("c_nationkey") == c("n_nationkey"))  # a fixed list of nations
    facts = N.show_facts(A.offers(spark, sf_dir)).join(homes.select(c("c_custkey").alias("show_id"), "venue"), "show_id")
    return facts.groupBy("venue").agg(F.count("*").alias("show_count"), F.sum("perf_count").alias("perf_count"), F.sum("offer_count").alias("offer_count"), F.bit_count(F.bit_or("sellers")).cast("long").alias("seller_count"))


# --- searches


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), 'r#00000001') OR contains(lower(n_name), 'r#00000001')")
def search_indexed(spark, sf_dir):
    """A search over titles and venues by the index of their pieces."""
    nations = A.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = A.read(spark, sf_dir, "customer").join(F.broadcast(nations), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_name", "n_name")
    path = scratch(spark)
    P.build(rows, path, "c_custkey", ["c_name", "n_name"])
    return P.lookup(rows, path, "c_custkey", ["c_name", "n_name"], " R#00000001 ")


_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"


@query(f"WITH s AS ({_WORDS}) SELECT w AS search_id, p_partkey FROM s JOIN part ON contains(lower(p_name), lower(w)) OR contains(lower(p_brand), lower(w)) WHERE w <> ''")
def searches_indexed(spark, sf_dir):
    """Every word of every title searched for at once, over titles and brands."""
    rows = A.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    path = scratch(spark)
    P.build(rows, path, "p_partkey", ["p_name", "p_brand"])
    words = rows.select(F.explode(F.split("p_name", " ")).alias("words")).distinct()
    return P.lookup_all(rows, path, "p_partkey", ["p_name", "p_brand"], words.select(c("words").alias("search_id"), "words")).select("search_id", "p_partkey")


_LISTED = "SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_name END AS name, p_brand FROM part WHERE p_size > 3"


@query(f"WITH s AS ({_WORDS}), now AS ({_LISTED}) SELECT w AS search_id, p_partkey FROM s JOIN now ON contains(lower(name), lower(w)) OR contains(lower(p_brand), lower(w)) WHERE w <> ''")
def searches_kept_up(spark, sf_dir):
    """The same searches by an index that was made before, kept up by changes and
    written whole again: small titles went, economy ones are new, promoted ones had
    their type for a name, and large ones lost theirs."""
    part = A.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    path, columns = scratch(spark), ["name", "p_brand"]
    before = part.where("p_type <> 'ECONOMY'").withColumn("name", F.expr("if(p_type = 'PROMO', p_type, p_name)"))
    now = part.where("p_size > 3").withColumn("name", F.expr("if(p_size <= 40, p_name, null)"))
    P.build(before, path, "p_partkey", columns)
    P.add(now.where("p_type in ('ECONOMY', 'PROMO')"), path, "p_partkey", columns, removed=part.where("p_size <= 3"))
    P.add(now.where("p_size > 40"), path, "p_partkey", columns)
    P.compact(spark, path)
    words = part.select(F.explode(F.split("p_name", " ")).alias("words")).distinct()
    return P.lookup_all(now.select("p_partkey", *columns), path, "p_partkey", columns, words.select(c("words").alias("search_id"), "words")).select("search_id", "p_partkey")


# --- fetch attempts

_POLICY = T.Policy(attempts=4, backoff=3600, deadline=5 * 86400)
_STATUS = "CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 404 WHEN 'click' THEN 503 WHEN 'error' THEN 429 END"


@query(
    f"""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts, {_STATUS} AS s, min(ts) OVER (PARTITION BY user_id) + INTERVAL 5 DAY AS upto FROM events),
d AS (SELECT *, CASE WHEN s = 200 THEN 'ok' WHEN s = 404 THEN 'refused' WHEN n >= 4 THEN 'exhausted' END AS e FROM a),
f AS (SELECT user_id, min(n) AS n FROM d WHERE e IS NOT NULL AND ts <= upto GROUP BY user_id),
l AS (SELECT user_id, max(n) AS n FROM a GROUP BY user_id)
SELECT l.user_id AS user_id, d.n::INT AS attempt, d.s AS status, CASE WHEN f.n IS NOT NULL THEN d.e WHEN TIMESTAMP '2024-01-20' > d.upto THEN 'deadline' ELSE 'pending' END AS outcome,
 CASE WHEN f.n IS NULL AND TIMESTAMP '2024-01-20' > d.upto THEN 'deadline, last ' || coalesce('HTTP ' || d.s, 'no answer') WHEN d.e = 'refused' THEN 'HTTP 404' WHEN f.n IS NOT NULL AND d.e = 'exhausted' THEN coalesce('HTTP ' || d.s, 'no answer') || ' after ' || d.n || ' attempts' END AS reason,
 CASE WHEN f.n IS NULL AND TIMESTAMP '2024-01-20' <= d.upto THEN d.ts + to_seconds(3600 * 2 ** (d.n - 1)) END AS next_at
FROM l LEFT JOIN f ON l.user_id = f.user_id JOIN d ON d.user_id = l.user_id AND d.n = coalesce(f.n, l.n)"""
)
def fetch_outcomes(spark, sf_dir):
    """What became of each fetch: events are answers, a user's in the order of time its attempts."""
    events = A.read(spark, sf_dir, "events")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    answers = events.select("user_id", attempt.alias("attempt"), c("ts").alias("at"), F.expr(_STATUS).alias("status"))
    return T.outcomes(answers, F.lit("2024-01-20").cast("timestamp_ntz"), ["user_id"], _POLICY)


_SHOWN = "CASE WHEN k % 7 = 0 THEN 'soon £900' ELSE 'from £' || (20 + k % 2) || ' or £3, £900' END"


@query(
    with_(
        SEEN,
        f"p AS (SELECT show_id, row_number() OVER (PARTITION BY show_id ORDER BY seen_at, seq) AS poll, CASE WHEN k % 7 > 0 THEN 20 + k % 2 END AS price, {_SHOWN} AS t FROM seen)",
        "q AS (SELECT *, price = lag(price) OVER w AND price = lag(price, 2) OVER w AS rest FROM p WINDOW w AS (PARTITION BY show_id ORDER BY poll))",
        "e AS (SELECT show_id, coalesce(min(poll) FILTER (rest), max(poll)) AS poll, coalesce(bool_or(rest), false) AS stable FROM q GROUP BY show_id)",
    )
    + "SELECT e.show_id AS show_id, e.poll::INT AS poll, stable, price::DOUBLE AS low, price::DOUBLE AS high, CASE WHEN price IS NULL THEN 0 ELSE 1 END AS n_prices, CASE WHEN price IS NULL THEN 'no prices in plausible range; saw 1 raw' ELSE 'chips' END AS note FROM e JOIN p ON e.show_id = p.show_id AND e.poll = p.poll"
)
def settled_prices(spark, sf_dir):
    """Pages that were polled until their visible prices stayed the same."""
    poll = F.row_number().over(Window.partitionBy("show_id").orderBy("seen_at", "seq"))
    polls = A.observations(spark, sf_dir).select("show_id", poll.alias("poll"), F.expr(_SHOWN).alias("text"))
    return T.settled(polls, ["show_id"])
