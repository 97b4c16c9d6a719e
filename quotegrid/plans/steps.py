"""Queries over checks, merges, history, resolution, quality and storage that ``pipeline`` has no place for."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text, times
from ..functions.registry import SOURCE_PRIORITY
from ..operators import checks as Q
from ..operators import display as L
from ..operators import history as H
from ..operators import merge as M
from ..operators import offers as O
from ..operators import resolve as R
from ..operators import verify as V
from ..sources import adapters as A
from ..sources import catalog as C
from ..sources.documents import write_document
from ..sources.paged import PagedJson, listing, write_pages
from ..sources.session import scratch, stage
from .base import D, EFF, OFFERS, SEEN, SHOWS, SQL, query, with_
from .pipeline import _RECORDS, _RECURSIVE, records

c = F.col


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observations(spark, sf_dir)


# --- checked prices


@query(with_(SEEN) + "SELECT seq, (CASE WHEN k % 4 = 0 THEN k WHEN k % 5 = 0 THEN NULL WHEN k % 3 > 0 THEN k + 10 WHEN k % 2 > 0 THEN k + 20 END)::DOUBLE AS price FROM seen")
def band_prices(spark, sf_dir):
    """The lowest open band; the advertised price where no band tells of seats, and none without seats."""
    band = lambda price, seats: F.struct((c("k") + price).cast("double").alias("price_value"), F.when(c("k") % 4 != 0, c("k") % seats).alias("seats_available"))
    return _seen(spark, sf_dir).select("seq", V.band_low_price(F.array(band(20, 2), band(10, 3)), c("k").cast("double"), c("k") % 5).alias("price"))


@query(with_(SEEN) + f"SELECT seq, date >= {D} AND date <= {D} + 14 AND CASE WHEN k % 4 > 0 THEN k % 4 ELSE 5 END < 3 AS scarce, date >= {D} AND date <= {D} + 14 AS near FROM seen")
def scarce_flags(spark, sf_dir):
    band = lambda price, seats: F.struct((c("k") + price).cast("double").alias("price_value"), seats.alias("seats_available"))
    return _seen(spark, sf_dir).select("seq", V.scarce_suspect(c("date"), F.array(band(20, F.lit(5)), band(10, c("k") % 4)), A.AS_OF).alias("scarce"), V.in_window(c("date"), A.AS_OF, 14).alias("near"))


@query(
    with_(SEEN, "p AS (SELECT seq, (date + 31 * (k % 3))::DATE AS date, time FROM seen WHERE k < 50)", "cal AS (SELECT date, time, arg_max(k, seq) AS price FROM seen WHERE k >= 50 AND day(date) % 2 = 0 GROUP BY date, time)")
    + "SELECT seq, p.date AS date, time, cal.price::DOUBLE AS calendar_price, CASE WHEN cal.price IS NOT NULL THEN 'ttd_calendar' WHEN month(p.date) = 2 THEN 'fetch_failed' ELSE 'not_in_calendar' END AS verified_price_source FROM p LEFT JOIN cal USING (date, time)"
)
def calendar_states(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    perfs = seen.where("k < 50").select("seq", F.expr("date_add(date, 31 * (k % 3))").alias("date"), "time")
    calendar = seen.where((c("k") >= 50) & (F.dayofmonth("date") % 2 == 0)).select("date", "time", c("k").cast("double").alias("price"), c("seq").alias("pos"))
    failed = spark.createDataFrame([(2024, 2), (2024, 2), (2023, 1)], "year int, month int")
    return V.calendar_check(perfs, calendar, failed)


@query(
    with_(SEEN, f"r AS (SELECT *, k % 2 = 0 AND k % 3 < 2 AND k % 5 < 3 AND date >= {D} AND date <= {D} + 7 AS gone FROM seen)")
    + "SELECT seq AS perf_id, gone AS removed, CASE WHEN gone THEN 0 ELSE k END::INT AS max_seats, CASE WHEN gone THEN '' ELSE 'InStock' END AS availability FROM r"
)
def calendar_removals(spark, sf_dir):
    seen = _seen(spark, sf_dir).withColumn("perf_id", c("seq"))
    old = seen.where("k % 2 = 0").select("perf_id", F.expr("element_at(array('calendar_api', 'calendar_only', 'jsonld_only'), k % 3 + 1)").alias("price_source"))
    new = seen.select("perf_id", "date", F.when(c("k") % 5 < 3, "jsonld_only").otherwise("calendar_api").alias("price_source"), c("k").alias("max_seats"), F.lit("InStock").alias("availability"))
    return V.removed(old, new, A.AS_OF, 7).select("perf_id", "removed", "max_seats", "availability")


@query(with_(SEEN) + "SELECT seq, CASE WHEN k % 3 = 0 THEN NULL ELSE abs(k % 4 - k % 5) <= 0 END AS agrees FROM seen")
def seat_agreement(spark, sf_dir):
    return _seen(spark, sf_dir).select("seq", V.agrees(F.when(c("k") % 3 != 0, (c("k") % 4).cast("double")), (c("k") % 5).cast("double")).alias("agrees"))


# --- merges


_PLACES = "CASE k % 3 WHEN 0 THEN 'https://x.example/shows/seats/' || show_id || '/0' WHEN 1 THEN 'https://x.example/shows/seats/' || show_id || '/5' ELSE 'https://x.example/other/0' END"


@query(
    with_(SEEN, "ids AS (SELECT date, time, min(seq) AS perf_id FROM seen WHERE day(date) % 2 = 0 GROUP BY date, time)")
    + "SELECT seq, CASE WHEN k % 3 = 0 AND perf_id IS NOT NULL THEN 'https://x.example/shows/seats/' || show_id || '/' || perf_id ELSE " + _PLACES + " END AS book_url FROM seen LEFT JOIN ids USING (date, time)"
)
def url_patches(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    ids = seen.where(F.dayofmonth("date") % 2 == 0).groupBy("date", "time").agg(F.min("seq").alias("perf_id"))
    return M.patch_urls(seen.withColumn("book_url", F.expr(_PLACES)), ids).select("seq", "book_url")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'A' || c_custkey WHEN c_custkey % 4 = 0 THEN 'B' || c_custkey END AS sku FROM customer")
def sku_backfill(spark, sf_dir):
    own = A.read(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_custkey") % 2 == 1, F.concat(F.lit("A"), "c_custkey")).alias("sku"))
    other = own.where("c_custkey % 4 < 2").select("c_custkey", F.concat(F.lit("B"), "c_custkey").alias("sku"))
    return M.backfill(own, other, "c_custkey", "sku")


@query(
    with_(OFFERS, "t AS (SELECT DISTINCT source AS tag, (DATE '2024-01-26' + source_ord)::DATE AS date FROM offers)", "d AS (SELECT DISTINCT show_id, source AS tag FROM offers)")
    + "SELECT show_id, tag, date FROM d JOIN t USING (tag) WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.show_id = d.show_id AND o.date = t.date)"
)
def ghost_deals(spark, sf_dir):
    off = A.offers(spark, sf_dir)
    tags = off.select(c("source").alias("tag"), F.date_add(F.lit("2024-01-26").cast("date"), c("source_ord")).alias("date")).distinct()
    perfs = off.groupBy("show_id", "date", "time").agg(F.min("price_from").alias("price"))
    return M.deals_by_date(off.select("show_id", c("source").alias("tag")).distinct(), tags, perfs)[1].select("show_id", "tag", "date")


# --- history

_TOLD = "(CASE WHEN (show_id + source_ord) % 3 <> 0 THEN price_from END)"


@query(
    with_(OFFERS, f"o AS (SELECT show_id, date, time, source, source_ord, {_TOLD} AS price, price_to, available, currency FROM offers)", "u AS (SELECT show_id, date, time, min(price) AS min, coalesce(max(price_to), max(price)) AS max, bool_or(available) AS any_available FROM o GROUP BY show_id, date, time)", "s AS (SELECT show_id, date, time, string_agg(source, ',' ORDER BY source) AS sources FROM o WHERE price IS NOT NULL OR price_to IS NOT NULL OR available IS NOT NULL GROUP BY show_id, date, time)")
    + "SELECT show_id, date, time, 'r1' AS t, min, max, any_available, coalesce(sources, '') AS sources FROM u LEFT JOIN s USING (show_id, date, time)"
)
def history_snapshot(spark, sf_dir):
    off = A.offers(spark, sf_dir).withColumn("price_from", F.expr(_TOLD))
    perfs = M.unify(off.withColumn("raw_ord", F.lit(0)))
    return H.snapshot(perfs, off, "r1").select(*H.KEY, "t", "min", "max", "any_available", F.array_join(F.transform("sources", lambda s: s["source"]), ",").alias("sources"))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A history of the observations before 20 January and a run from those after it, by seller and show."""
    seen = _seen(spark, sf_dir).select(c("show_id").cast("string").alias("show_id"), F.date_add(F.lit("2024-01-05").cast("date"), c("source_ord") * 2).cast("string").alias("date"), "time", "seq", (c("k") % 4).cast("double").alias("min"), c("date").alias("day"), (c("show_id") % 3).alias("third"))
    early = F.lit("2024-01-20").cast("date")
    old = seen.where(c("day") < early).select(*H.KEY, F.lit("run1").alias("t"), "seq", "min")
    new = seen.where(c("day") >= early).groupBy(*H.KEY).agg(F.max_by("min", "seq").alias("min"), F.first("third").alias("third"))
    return old, new.select(*H.KEY, F.when(c("third") == 0, "run1").otherwise("run2").alias("t"), "min")


_LOG = """log AS (SELECT show_id, (DATE '2024-01-05' + source_ord * 2)::DATE::VARCHAR AS date, time, seq, (k % 4)::DOUBLE AS min, date AS day FROM seen),
h AS (SELECT * FROM log WHERE day < DATE '2024-01-20'), lst AS (SELECT show_id, date, time, arg_max(min, seq) AS min FROM h GROUP BY ALL),
n AS (SELECT show_id, date, time, arg_max(min, seq) AS min FROM log WHERE day >= DATE '2024-01-20' GROUP BY ALL),
f AS (SELECT n.*, CASE WHEN lst.show_id IS NULL THEN 'append' WHEN n.show_id % 3 = 0 THEN 'replay' WHEN n.min IS DISTINCT FROM lst.min THEN 'append' ELSE 'same' END AS fate FROM n LEFT JOIN lst ON n.show_id = lst.show_id AND n.date = lst.date AND n.time = lst.time)"""


@query(with_(SEEN, _LOG) + "SELECT show_id::VARCHAR AS show_id, date, time, min, fate FROM f")
def history_replay(spark, sf_dir):
    return H.decide(*_log(spark, sf_dir)).select(*H.KEY, "min", "fate")


@query(
    with_(SEEN, _LOG, "now AS (SELECT show_id, date FROM h UNION ALL SELECT show_id, date FROM f WHERE fate = 'append')")
    + f"SELECT (SELECT count(*) FROM f WHERE fate = 'append') AS appended, (SELECT count(*) FROM f WHERE fate <> 'append') AS suppressed, (SELECT count(*) FROM now WHERE NOT (date::DATE >= {D} AND show_id % 5 <> 0)) AS pruned"
)
def history_stats(spark, sf_dir):
    live = _seen(spark, sf_dir).where("show_id % 5 <> 0").select(c("show_id").cast("string").alias("show_id"))
    return H.stats(*_log(spark, sf_dir), live, A.AS_OF)


@query(with_(SEEN, _LOG, "one AS (SELECT show_id, date, time FROM h ORDER BY seq LIMIT 1)") + "SELECT seq, h.min AS min FROM h JOIN one ON h.show_id = one.show_id AND h.date = one.date AND h.time = one.time")
def history_lookup(spark, sf_dir):
    """The rows of the performance that was seen first."""
    old, _ = _log(spark, sf_dir)
    key = old.orderBy("seq").select(*H.KEY).first()
    return L.history_of(old, *key).select("seq", "min")


# --- resolution


_SHOWS = f"s AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, p_brand, p_type, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS pos FROM part), src AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(SOURCE_PRIORITY))}) v(k, source))"
_EXTRACTED = (
    with_(_SHOWS)
    + "SELECT k * 1000000000 + pos AS rec_id, source, CASE k WHEN 3 THEN 'slug-' ELSE '' END || p_partkey AS source_id, p_name AS title_raw, p_brand AS venue_raw, CASE WHEN p_partkey % 3 <> 0 THEN 'u' || p_partkey END AS url, CASE WHEN k > 0 THEN '\"' || p_type || '\" }, {' END AS description FROM s JOIN src USING (k)"
)


def _documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as the shows of five sources, each with its own names of fields: one has venues as structs, one leaves out descriptions."""
    part, k = A.read(spark, sf_dir, "part"), c("p_partkey")
    url, text = F.when(k % 3 != 0, F.concat(F.lit("u"), k)), F.concat(F.lit('"'), "p_type", F.lit('" }, {'))
    perfs = F.array(F.struct(F.lit("2024-01-10").alias("date"), c("p_retailprice").alias("price")), F.struct(F.lit("2024-01-11").alias("date"), F.lit(None).cast("double").alias("price")))
    out = {}
    for i, (source, names) in enumerate((s, C.SHOW_FIELDS[s]) for s in SOURCE_PRIORITY):
        number = F.concat(F.lit("slug-"), k) if names["source_id"] == "slug" else k
        venue = F.struct(c("p_brand").alias("name")).alias("venue") if "." in names["venue"] else c("p_brand").alias(names["venue"])
        rest = [text.alias(names["description"])] if i else []
        out[source] = part.where(k % 5 == i).select(k.alias("__order"), number.alias(names["source_id"]), c("p_name").alias(names["title"]), venue, url.alias(names["url"]), *rest, perfs.alias(names["performances"]))
    return out


def _written_documents(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch(spark)
    for source, rows in _documents(spark, sf_dir).items():
        write_document(rows, f"{folder}/{source}.json", "__order")
    A.read(spark, sf_dir, "region").write.json(f"{folder}/other.json")
    return folder


@query(_EXTRACTED)
def sources_loaded(spark, sf_dir):
    """Five documents, written by many tasks and cut by byte ranges when they are loaded; another file there is passed over."""
    return C.extract_shows(C.load_shows(spark, _written_documents(spark, sf_dir)))


@query(_EXTRACTED)
def records_extracted(spark, sf_dir):
    """The same records from shows that are rows already, placed without bringing them into one task."""
    shows = {s: O.ranked(rows.select("__order", F.to_json(F.struct(*[x for x in rows.columns if x != "__order"])).alias("body")), [F.floor(c("__order") / 1000)], [c("__order")], "n").select((c("n") - 1).cast("long").alias("pos"), "body") for s, rows in _documents(spark, sf_dir).items()}
    return C.extract_shows(shows)


@query(with_(_SHOWS) + "SELECT 4000000000 + pos AS rec_id, i AS raw_ord, '2024-01-1' || i AS date, CASE WHEN i = 0 THEN p_retailprice END AS price FROM s JOIN part USING (p_partkey), (VALUES (0), (1)) v(i) WHERE k = 4")
def performances_loaded(spark, sf_dir):
    """What is nested in the members of one document."""
    folder = scratch(spark)
    write_document(_documents(spark, sf_dir)["ttd"], f"{folder}/ttd.json", "__order")
    return C.extract_show_performances(C.load_shows(spark, folder)["ttd"], "ttd", 4, "date string, price double")


_EXACT = "k AS (SELECT *, min(rec_id) OVER (PARTITION BY title_norm, venue_norm) AS cluster_id FROM rec)"


@query(with_(_RECORDS, _EXACT) + "SELECT cluster_id, any_value(title_norm) AS title_norm, any_value(venue_norm) AS venue_norm, any_value(source) AS source FROM k GROUP BY cluster_id HAVING count(*) = 1")
def review_singletons(spark, sf_dir):
    clustered, orphans = R.exact_clusters(R.normalized(records(spark, sf_dir)))
    log = spark.createDataFrame([], "fate string")
    return R.review(clustered, orphans, log)["singletons"]


@query(with_(_RECORDS) + "SELECT rec_id, source, title_norm FROM rec WHERE rec_id % 7 = 0")
def review_orphans(spark, sf_dir):
    rec = records(spark, sf_dir).withColumn("venue_raw", F.when(c("rec_id") % 7 != 0, c("venue_raw")))
    clustered, orphans = R.exact_clusters(R.normalized(rec))
    return R.review(clustered, orphans, spark.createDataFrame([], "fate string"))["orphans"].select("rec_id", "source", "title_norm")


@query(
    with_(_RECORDS, _EXACT)
    + "SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY p, rec_id) AS rank, source, rec_id::VARCHAR AS source_id, title_raw, 100 AS confidence FROM k"
)
def cluster_sources(spark, sf_dir):
    return R.source_rows(R.exact_clusters(R.normalized(records(spark, sf_dir)))[0]).select("cluster_id", "rank", "source", "source_id", "title_raw", "confidence")


def _source_of(rec: int) -> str:
    return SOURCE_PRIORITY[rec % 5]


def _ref(rec: int) -> dict[str, str]:
    return {"source": _source_of(rec), "source_id": str(rec)}


_RULES = {"force_split": [{"record": _ref(5)}, {"record": {"source": "olt", "source_id": "none"}}], "force_merge": [{"records": [_ref(2), _ref(3)]}, {"records": []}, {"records": [{"source": "x", "source_id": "9"}]}]}


@query(
    with_(_RECORDS, _EXACT, "x AS (SELECT rec_id, CASE WHEN rec_id = 5 THEN -6 ELSE cluster_id END AS c FROM k)", "z AS (SELECT c, count(*) AS n FROM x GROUP BY c)", "d AS (SELECT arg_max(c, row(n, -rec_id)) AS c FROM x JOIN z USING (c) WHERE rec_id IN (2, 3))")
    + "SELECT rec_id, CASE WHEN rec_id IN (2, 3) THEN (SELECT c FROM d) ELSE x.c END AS cluster_id FROM x"
)
def overrides_applied(spark, sf_dir):
    """A record split off, two records brought together in the larger cluster, and rules that change nothing."""
    return R.override(R.exact_clusters(R.normalized(records(spark, sf_dir)))[0], _RULES)[0].select("rec_id", "cluster_id")


@query(SQL["overrides_applied"])
def overrides_loaded(spark, sf_dir):
    """The same rules from a file; a section that is null is empty, and a file that isn't there has no rules."""
    path = f"{scratch(spark)}/rules.json"
    C.write_text(spark, path, json.dumps(_RULES))
    clustered = R.exact_clusters(R.normalized(records(spark, sf_dir)))[0]
    split, rest = C.load_overrides(spark, path), C.load_overrides(spark, f"{path}-none")
    return R.override(R.override(clustered, split)[0], rest)[0].select("rec_id", "cluster_id")


@query(_RECURSIVE + " SELECT venue_norm, title_a, title_b, score, fate FROM st WHERE fate IN ('review', 'blocked')")
def review_pairs(spark, sf_dir):
    """Pairs that people should look at: close ones, and those that a common source keeps apart."""
    clustered, orphans = R.exact_clusters(R.normalized(records(spark, sf_dir)))
    return R.review(clustered, orphans, R.fuzzy_merge(clustered)[1])["pairs"]


@query()
def title_scores(spark, sf_dir):
    """Pairs behind the gate with both scores: by subsequences, and by matching blocks (compared with a plain version in the tests)."""
    clustered = R.exact_clusters(R.normalized(records(spark, sf_dir)))[0]
    titles = clustered.select("venue_norm", c("title_norm").alias("id"), c("title_norm").alias("title")).distinct()
    pairs = R.gate_pairs(titles, ["venue_norm"]).select(c("a_title").alias("title_a"), c("b_title").alias("title_b")).distinct()
    return pairs.withColumns({"score": similarity.score_udf("title_a", "title_b"), "other": similarity.block_score_udf("title_a", "title_b")})


# --- history by performance


_CHANGES = f"""h AS (SELECT show_id, (DATE '2024-01-05' + source_ord * 2)::DATE::VARCHAR AS date, time, seq, (k % 4)::DOUBLE AS min FROM seen WHERE k % 2 = 0),
a AS (SELECT show_id, (DATE '2024-01-05' + source_ord * 2)::DATE::VARCHAR AS date, time, seq AS asked FROM seen WHERE k % 2 = 1)"""


def _by_performance(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Half of the observations as a history in a table of its own (its name), and the others as questions about it."""
    seen = _seen(spark, sf_dir).select(c("show_id").cast("string").alias("show_id"), F.date_add(F.lit("2024-01-05").cast("date"), c("source_ord") * 2).cast("string").alias("date"), "time", "seq", (c("k") % 4).cast("double").alias("min"), "k")
    history = seen.where("k % 2 = 0").select(*H.KEY, F.lit("run1").alias("t"), "seq", "min")
    name = f"history_{uuid.uuid4().hex}"
    H.save_by_performance(history, name, 8, scratch(spark))
    return name, seen.where("k % 2 = 1").select(*H.KEY, c("seq").alias("asked"))


@query(with_(SEEN, _CHANGES) + "SELECT asked, h.seq AS seq, h.min AS min FROM a ASOF LEFT JOIN h ON a.show_id = h.show_id AND a.date = h.date AND a.time = h.time AND a.asked >= h.seq")
def history_as_of(spark, sf_dir):
    """What the history said at the time of every other observation, for all performances at once."""
    name, asks = _by_performance(spark, sf_dir)
    return H.as_of(spark.table(name), asks, "asked").select("asked", "seq", "min")


@query(
    with_(SEEN, _CHANGES, "l AS (SELECT show_id, date, time, max(seq) AS seq, arg_max(min, seq) AS min FROM h GROUP BY ALL)", "n AS (SELECT show_id, date, time, max(asked) % 4 AS min FROM a GROUP BY ALL)")
    + "SELECT show_id::VARCHAR AS show_id, date, time, seq, min FROM h UNION ALL SELECT n.show_id::VARCHAR, n.date, n.time, coalesce(l.seq, 0) + 1, n.min FROM n LEFT JOIN l ON n.show_id = l.show_id AND n.date = l.date AND n.time = l.time WHERE l.min IS DISTINCT FROM n.min"
)
def history_appended(spark, sf_dir):
    """A snapshot appended to the table of a history, and the table read."""
    name, asks = _by_performance(spark, sf_dir)
    snap = asks.groupBy(*H.KEY).agg((F.max("asked") % 4).cast("double").alias("min")).withColumn("t", F.lit("run2"))
    return H.append_to(name, snap, 8).select(*H.KEY, "seq", "min")


_ENTRIES = "last AS (SELECT show_id, source, arg_max(k, seq) AS k, max(seen_at) AS seen_at FROM seen GROUP BY ALL), e AS (SELECT show_id || '|' || source AS key, k, seen_at FROM last)"
_MERGED = "m AS (SELECT key, CASE WHEN k % 5 = 0 THEN k + 100 ELSE k END AS value, seen_at AS stored_at FROM e WHERE k % 7 <> 3 OR k % 5 = 0)"
_CACHE = "key string, value long, stored_at timestamp_ntz"


def _changed_cache(spark: SparkSession, sf_dir: str) -> str:
    """A cache of three saves: all entries; those that are told otherwise, of which only these are written; and removals."""
    path = f"{scratch(spark)}/cache"
    seen = _seen(spark, sf_dir).groupBy("show_id", "source").agg(F.max_by("k", "seq").cast("long").alias("k"), F.max("seen_at").alias("stored_at"))
    entries = stage(seen.select(F.concat_ws("|", "show_id", "source").alias("key"), c("k").alias("value"), "stored_at"))
    C.save_changes(entries, path)
    gone = entries.where("value % 7 = 3").select("key")
    fresh = entries.withColumn("value", F.when(c("value") % 5 == 0, c("value") + 100).otherwise(c("value")))
    C.save_changes(entries.limit(0), path, gone)
    C.save_changes(C.changed_entries(C.load_changes(spark, path, _CACHE), fresh.where("value >= 100"), "key"), path)
    return path


@query(with_(SEEN, _ENTRIES, _MERGED) + "SELECT * FROM m")
def cache_changes(spark, sf_dir):
    """A cache as its runs give it: base, tombstones, replaced entries."""
    return C.load_changes(spark, _changed_cache(spark, sf_dir), _CACHE)


@query(with_(SEEN, _ENTRIES, _MERGED) + "SELECT * FROM m WHERE stored_at >= TIMESTAMP '2024-01-20 00:00:00'")
def cache_compacted(spark, sf_dir):
    """The same cache after a compaction that leaves out what is too old."""
    path = _changed_cache(spark, sf_dir)
    C.compact_changes(spark, path, _CACHE, c("stored_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return C.load_changes(spark, path, _CACHE)


# --- quality


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'critical' WHEN n_nationkey < 20 * 0.8 THEN 'error' WHEN n_nationkey < 20 * 0.9 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN n_nationkey % 4 = 0 THEN 'idle' WHEN n_nationkey % 4 > 1 THEN 'ok' WHEN n_nationkey % 2 = n_nationkey % 4 AND n_nationkey % 3 = 0 THEN 'blocked' ELSE 'drift' END AS status FROM nation")
def run_levels(spark, sf_dir):
    """How a run is judged by what it found and by how its attempts ended."""
    k = c("n_nationkey")
    attempts = k % 4
    return A.read(spark, sf_dir, "nation").select("n_nationkey", Q.coverage_level(k, F.lit(20)).alias("level"), Q.run_status(attempts, F.when(attempts > 1, 1).otherwise(0), F.when(k % 3 == 0, attempts).otherwise(0)).alias("status"))


@query("SELECT count(*) AS n, count(*) FILTER (page_id % 5 = 0) AS mismatches, count(*) FILTER (page_id % 5 = 0) > count(*) * 0.1::DOUBLE AS exceeded FROM pages WHERE page_id % 7 <> 0")
def canonical_mismatch(spark, sf_dir):
    own = c("url")
    canonical = F.when(c("page_id") % 7 == 0, None).when(c("page_id") % 5 == 0, F.concat(own, F.lit("x"))).when(c("page_id") % 2 == 0, F.concat(F.rtrim(own, F.lit("/")), F.lit("//"))).otherwise(own)
    return Q.url_mismatch(A.read(spark, sf_dir, "pages").select("url", canonical.alias("canonical")), "canonical", "url")


_SHOW_RULES = {
    "empty_name": "c_custkey % 6 = 0", "empty_venue": "false", "rating_out_of_range": "c_acctbal > 5 OR c_acctbal < 0", "foreign_url": "c_custkey % 4 = 1", "sku_differs": "c_custkey % 3 = 1", "odd_price": "NOT (c_acctbal = 0 OR c_acctbal BETWEEN 1 AND 500)",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n FROM customer" for k, v in _SHOW_RULES.items()))
def show_validation(spark, sf_dir):
    k = c("c_custkey")
    rows = A.read(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 6 == 0, " ").otherwise(c("c_name")).alias("title"), c("c_mktsegment").alias("venue"), c("c_acctbal").alias("rating"), c("c_acctbal").alias("price"),
        F.when(k % 4 == 1, "https://other.example/x").when(k % 4 == 2, None).otherwise("https://own.example/x").alias("url"), F.when(k % 3 == 1, F.concat(k, F.lit("x"))).when(k % 3 == 2, k.cast("string")).alias("sku"),
    )
    return Q.rule_counts(rows, Q.show_rules("https://own.example/"))


@query("SELECT page_id, 'missing: no parsed page' AS failure FROM pages WHERE page_id % 9 = 0")
def failed_pages(spark, sf_dir):
    pages = A.read(spark, sf_dir, "pages").select("page_id")
    return C.failures(pages, pages.where("page_id % 9 <> 0"), "page_id")


# --- storage


def _paged(spark: SparkSession, sf_dir: str, limit: int) -> str:
    """Customers as the pages of a listing that tells no total; after its end it says the last row again."""
    folder, rows = scratch(spark), A.read(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    write_pages(O.ranked(rows, [F.floor(c("id") / 1000)], [c("id")], "n").select((c("n") - 1).alias("pos"), "id", "name"), folder, limit)
    return folder


_PAGED = "SELECT c_custkey::VARCHAR AS key, (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS pos, c_name AS name FROM customer"


@query(_PAGED)
def paged_listing(spark, sf_dir):
    """A listing whose end is found by doubling and halving, read by many tasks."""
    folder = _paged(spark, sf_dir, 20)
    return listing(spark, folder, limit="20").select("key", "pos", F.get_json_object("body", "$.name").alias("name"))


@query(_PAGED)
def paged_stream(spark, sf_dir):
    """The same listing as a stream that reads what has been added since."""
    folder, out = _paged(spark, sf_dir, 20), scratch(spark)
    spark.dataSource.register(PagedJson)
    rows = spark.readStream.format("paged_json").option("path", folder).option("limit", "20").load()
    rows.select("key", "pos", F.get_json_object("body", "$.name").alias("name")).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema("key string, pos int, name string").parquet(f"{out}/rows")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0")
def runs_kept(spark, sf_dir):
    """Three runs written, the oldest dropped, the last read; one is written twice."""
    folder, rows = scratch(spark), A.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for i in (1, 2, 3, 3):
        C.write_run(rows.where(c("n_nationkey") % i == 0), folder, f"{i:03d}", keep=2)
    return C.read_run(spark, folder)


@query("SELECT n_nationkey AS n_nationkey, n_name FROM nation")
def export_round_trip(spark, sf_dir):
    folder = scratch(spark)
    C.write_export(A.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{folder}/out")
    return C.read_export(spark, f"{folder}/out", f"{folder}/none")[0].select(c("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


_SOURCES = "map<string, struct<price_from: double, price_to: double, currency: string, book_url: string, available: boolean>>"


@query(
    with_(OFFERS)
    + "SELECT o.show_id AS show_id, c_name AS title, date::VARCHAR AS date, time, min(price_from) OVER w AS lowest, bool_or(available) OVER w AS any_available, source, price_from, price_to, book_url, available FROM offers o JOIN customer ON c_custkey = o.show_id WINDOW w AS (PARTITION BY o.show_id, date, time)"
)
def payload_round_trip(spark, sf_dir):
    """The unified catalogue in its nested form, a line for each show, written and taken apart again."""
    off = A.offers(spark, sf_dir).withColumns({"raw_ord": F.lit(0), "date": c("date").cast("string")})
    shows = A.read(spark, sf_dir, "customer").select(c("c_custkey").alias("show_id"), c("c_name").alias("title"))
    path = scratch(spark)
    C.write_export(C.catalogue_payload(shows, M.unify(off), off), path)
    perfs = C.read_export(spark, path)[0].select("show_id", "title", F.explode("performances").alias("p"))
    offers = perfs.select("show_id", "title", "p.date", "p.time", c("p.min_price").alias("lowest"), "p.any_available", F.explode(F.from_json("p.sources", _SOURCES)).alias("source", "o"))
    return offers.select("show_id", "title", "date", "time", "lowest", "any_available", "source", "o.price_from", "o.price_to", "o.book_url", "o.available")


@query(
    with_(OFFERS, "n AS (SELECT count(*) AS sources FROM offers GROUP BY show_id, date, time)")
    + """SELECT 'performances by number of sellers' AS line UNION ALL SELECT concat('  ', sources, ' | ', count(*)) FROM n GROUP BY sources
UNION ALL SELECT 'offers by seller' UNION ALL SELECT concat('  ', source, ' | ', count(*), ' | ', count(*) FILTER (available)) FROM offers GROUP BY source"""
)
def report_lines(spark, sf_dir):
    """The plain text of a run: how many sellers performances have, and each seller's offers and those known to be available."""
    off = A.offers(spark, sf_dir).withColumn("raw_ord", F.lit(0))
    spread = M.unify(off).groupBy("source_count").agg(F.count("*").alias("n")).orderBy("source_count")
    sellers = off.groupBy("source").agg(F.count("*").alias("n"), F.count_if("available").alias("open")).orderBy("source")
    path = f"{scratch(spark)}/report.txt"
    C.write_text(spark, path, C.report(spark, {"performances by number of sellers": spread, "offers by seller": sellers}))
    return spark.read.text(path).select(c("value").alias("line"))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation")
def cache_round_trip(spark, sf_dir):
    folder = scratch(spark)
    C.save_cache(A.read(spark, sf_dir, "nation").select(c("n_nationkey").cast("int").alias("k"), c("n_name").alias("v")), folder)
    return C.load_cache(spark, folder, "k int, v string").unionByName(C.load_cache(spark, f"{folder}-none", "k int, v string"))


@query(with_(SEEN, "h AS (SELECT show_id, date, time, row_number() OVER (PARTITION BY show_id, date, time ORDER BY seq) AS seq, k::DOUBLE AS min FROM seen WHERE seen_at IS NOT NULL)") + "SELECT show_id::VARCHAR AS show_id, date::VARCHAR AS date, time, seq, min FROM h")
def history_round_trip(spark, sf_dir):
    """A history as one JSON text for each show, written and read again."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("show_id", "date", "time").orderBy("seq")).cast("long")
    h = _seen(spark, sf_dir).select(c("show_id").cast("string").alias("show_id"), c("date").cast("string").alias("date"), "time", order.alias("seq"), F.lit("r").alias("t"), c("k").cast("double").alias("min"), F.lit(None).cast("double").alias("max"), F.lit("GBP").alias("currency"), F.lit(None).cast("boolean").alias("any_available"))
    folder = scratch(spark)
    C.history_to_json(h).select(F.to_json(F.create_map("show_id", F.from_json("value", "map<string, array<struct<t: string, min: double, max: double, currency: string, any_available: boolean>>>"))).alias("value")).select(F.concat(F.lit('{"shows":'), "value", F.lit("}")).alias("value")).write.text(folder)
    return C.history_from_json(spark, folder, whole=False).select("show_id", "date", "time", "seq", "min")


# --- sorting, labels and keys


@query(
    with_(EFF, SHOWS, f"t AS (SELECT e.show_id, e.show_ord, e.time, e.price, title, venue FROM eff e JOIN shows USING (show_id) WHERE date = {D})")
    + "SELECT show_id, time, row_number() OVER (ORDER BY price, show_ord, time) AS by_price, row_number() OVER (ORDER BY time, show_ord) AS by_time, row_number() OVER (ORDER BY venue, show_ord, time) AS by_venue, row_number() OVER (ORDER BY title, show_ord, time) AS by_title FROM t"
)
def for_date_sorted(spark, sf_dir):
    rows = O.between(O.effective(A.offers(spark, sf_dir, A.AS_OF)), A.AS_OF, 1).join(A.shows(spark, sf_dir).select("show_id", "title", "venue"), "show_id")
    return L.sorted_ranks(rows).select("show_id", "time", "by_price", "by_time", "by_venue", "by_title")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '—' WHEN o_orderkey % 7 < 1 THEN (1 + o_orderkey % 59) || 'm ago' WHEN o_orderkey % 7 < 2 THEN (1 + o_orderkey % 23) || 'h ago' WHEN o_orderkey % 7 < 3 THEN (1 + o_orderkey % 6) || 'd ago' ELSE (1 + o_orderkey % 50) || 'w ago' END AS label FROM orders")
def relative_times(spark, sf_dir):
    k = c("o_orderkey")
    seconds = F.expr("case when o_orderkey % 7 < 1 then (1 + o_orderkey % 59) * 60 when o_orderkey % 7 < 2 then (1 + o_orderkey % 23) * 3600 when o_orderkey % 7 < 3 then (1 + o_orderkey % 6) * 86400 else (1 + o_orderkey % 50) * 604800 end")
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    then = F.when(k % 11 != 0, F.timestamp_seconds(F.unix_timestamp(now) - seconds + 20))
    return A.read(spark, sf_dir, "orders").select("o_orderkey", times.relative_time(then, now).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN 'other' ELSE list_value('Official London Theatre', 'TodayTix', 'LOVEtheatre', 'SeatPlan', 'Theatre Tickets Direct')[c_custkey % 6 + 1] END AS seller, CASE WHEN c_custkey % 3 <> 0 THEN concat('2024-01-10|19:30|u', c_custkey) END AS perf_key, regexp_replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN ' THEATRE' ELSE '' END, ' THEATRE$', '') AS venue FROM customer")
def seller_names(spark, sf_dir):
    k = c("c_custkey")
    source = F.when(k % 6 == 5, "other").otherwise(F.array(*map(F.lit, SOURCE_PRIORITY))[(k % 6).cast("int")])
    url = F.when(k % 3 != 0, F.concat(F.lit("u"), k))
    return A.read(spark, sf_dir, "customer").select("c_custkey", text.seller_label(source).alias("seller"), text.perf_key(F.lit("2024-01-10").cast("date"), F.lit("19:30"), url).alias("perf_key"), L.short_venue(F.concat("c_name", F.when(k % 2 == 0, " THEATRE").otherwise(""))).alias("venue"))


@query("SELECT p_brand, greatest(20, (ceil((max(p_size) + 5) / 10.0) * 10)::INT)::INT AS top FROM part GROUP BY p_brand")
def axis_tops(spark, sf_dir):
    return A.read(spark, sf_dir, "part").groupBy("p_brand").agg(L.axis_top(c("p_size").cast("double")).alias("top"))


@query(with_(SEEN) + "SELECT seq, show_id FROM seen ORDER BY seq LIMIT 100")
def first_suspects(spark, sf_dir):
    """The first rows for an expensive check, taken before it: the limit goes down to each task."""
    return O.limited(_seen(spark, sf_dir).select("seq", "show_id"), 100, "seq")
