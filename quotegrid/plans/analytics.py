"""The analytic queries over offers, by day, week, month, show, seller and venue."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import offers as O
from ..operators import display as V
from ..operators import shows as S
from ..sources import adapters as A
from .base import D, EFF, OFFERS, PERFS, SHOWS, VALID, bucket, cuts, label, query, with_

VENUE = "nation-3"


def _eff(spark: SparkSession, sf_dir: str, start: datetime.date | None = None, days: int | None = None) -> DataFrame:
    return O.effective(_offers(spark, sf_dir, start, days))


def _offers(spark: SparkSession, sf_dir: str, start: datetime.date | None = A.AS_OF, days: int | None = None) -> DataFrame:
    """Offers of performances from a day on, of so many days."""
    return A.offers(spark, sf_dir, start, start + datetime.timedelta(days=days) if start and days else None)


@query(with_(EFF) + "SELECT show_id, date, time, seller, price, seller_count FROM eff")
def effective_cheapest(spark, sf_dir):
    return _eff(spark, sf_dir).select("show_id", "date", "time", "seller", "price", "seller_count")


@query(with_(EFF) + f"SELECT show_id, time, seller, price, seller_count FROM eff WHERE date = {D}")
def for_date(spark, sf_dir):
    return O.for_date(_eff(spark, sf_dir, A.AS_OF, 1), A.AS_OF)


@query(with_(OFFERS, SHOWS) + f"SELECT show_id, title, venue FROM shows WHERE show_id IN (SELECT show_id FROM offers WHERE date >= {D})")
def upcoming_shows(spark, sf_dir):
    return O.upcoming(A.shows(spark, sf_dir), _offers(spark, sf_dir), A.AS_OF).select("show_id", "title", "venue")


_TONIGHT = f"date = {D} AND NOT coalesce(CASE WHEN split_part(time, ':', 1)::INT <= 23 THEN split_part(time, ':', 1)::INT * 60 + split_part(time, ':', 2)::INT END < {A.NOW_MINUTES} + 20, false)"


@query(with_(EFF) + f"SELECT row_number() OVER (ORDER BY price, show_ord, time) AS rank, show_id, time, seller, price FROM eff WHERE {_TONIGHT} QUALIFY rank <= 5")
def tonight(spark, sf_dir):
    rows = O.tonight(_eff(spark, sf_dir, A.AS_OF, 1), A.AS_OF, A.NOW_MINUTES)
    return O.first_rows(rows, [F.col("price"), F.col("show_ord"), F.col("time")], 5).select("rank", "show_id", "time", "seller", "price")


@query(with_(EFF) + f"SELECT min(price) AS floor, count(*) AS perf_count, count(DISTINCT show_id) AS show_count, count(DISTINCT CASE WHEN price < 35 THEN show_id END) AS under_count FROM eff WHERE {_TONIGHT}")
def tonight_stats(spark, sf_dir):
    return O.tonight_stats(_eff(spark, sf_dir, A.AS_OF, 1), A.AS_OF, A.NOW_MINUTES)


def _days(start: str, days: int) -> str:
    return f"days AS (SELECT ({start} + i::INT)::DATE AS date FROM range({days}) t(i))"


_FLOORS = "fl AS (SELECT date, min(price) AS floor, count(DISTINCT show_id) AS show_count, count(*) AS perf_count FROM eff WHERE date IN (SELECT date FROM days) GROUP BY date)"


@query(with_(EFF, _days(D, 7), _FLOORS, f"cuts AS ({cuts('floor', 'fl')})") + f"SELECT days.date AS date, floor, coalesce(show_count, 0) AS show_count, floor IS NULL AS is_dark, CASE WHEN floor IS NULL THEN 5 ELSE {bucket('floor')} END AS bucket FROM days LEFT JOIN fl USING (date), cuts")
def week_days(spark, sf_dir):
    return O.week_days(_eff(spark, sf_dir, A.AS_OF, 7), A.AS_OF)


_BEST = "best AS (SELECT date, show_id, show_ord, time, price FROM eff QUALIFY row_number() OVER (PARTITION BY date, show_id ORDER BY price, time) = 1)"


@query(with_(EFF, _BEST) + f"SELECT date, row_number() OVER (PARTITION BY date ORDER BY price, show_ord) AS rank, show_id, time, price FROM best WHERE date >= {D} AND date < {D} + 7 QUALIFY rank <= 5")
def week_top5(spark, sf_dir):
    return O.top_shows(O.between(_eff(spark, sf_dir, A.AS_OF, 7), A.AS_OF, 7), 5)


@query(
    with_(
        EFF,
        f"w AS (SELECT * FROM eff WHERE date >= {D} AND date < {D} + 7)",
        "b AS (SELECT show_id, date, time, price FROM w QUALIFY row_number() OVER (PARTITION BY show_id ORDER BY price, date, time) = 1)",
        "o AS (SELECT b.show_id, min(w.price) AS lo, max(w.price) AS hi FROM b JOIN w ON b.show_id = w.show_id AND w.price > b.price GROUP BY b.show_id)",
    )
    + f"SELECT b.show_id AS show_id, date, time, price, lo AS other_low, hi AS other_high, {label('lo', 'hi')} AS other_range FROM b LEFT JOIN o ON b.show_id = o.show_id"
)
def week_best_per_show(spark, sf_dir):
    return O.week_best(_eff(spark, sf_dir, A.AS_OF, 7), A.AS_OF)


_MONTH = "DATE '2024-01-01'"


@query(with_(EFF, _days(_MONTH, 31), _FLOORS, f"cuts AS ({cuts('floor', 'fl')})") + f"SELECT days.date AS date, floor, floor IS NULL AS is_dark, days.date < {D} AS is_past, CASE WHEN floor IS NOT NULL THEN {bucket('floor')} - 1 END AS bucket FROM days LEFT JOIN fl USING (date), cuts")
def month_days(spark, sf_dir):
    return O.month_days(_eff(spark, sf_dir, *O.month_start(A.AS_OF)), A.AS_OF)


@query(with_(EFF) + f"SELECT date, price, show_id FROM eff WHERE date >= {D} AND date < {_MONTH} + 31 AND isodow(date) <= 4 ORDER BY price, date, show_ord, time LIMIT 1")
def month_cheapest_weeknight(spark, sf_dir):
    return O.cheapest_weeknight(_eff(spark, sf_dir, *O.month_start(A.AS_OF)), A.AS_OF)


@query(with_(OFFERS, SHOWS) + f"SELECT show_id, title, max_price - min_price AS range FROM shows WHERE min_price > 0 AND max_price > 0 AND show_id IN (SELECT show_id FROM offers WHERE date >= {D} AND date < {_MONTH} + 31) ORDER BY range DESC, show_ord LIMIT 1")
def month_widest_range(spark, sf_dir):
    return O.widest_range(A.shows(spark, sf_dir), _offers(spark, sf_dir, *O.month_start(A.AS_OF)), A.AS_OF)


@query(with_(EFF) + f"SELECT (SELECT count(DISTINCT show_id) FROM offers WHERE date >= {_MONTH} AND date < {_MONTH} + 31) AS show_count, (SELECT count(DISTINCT date) FROM eff WHERE date >= {_MONTH} AND date < {_MONTH} + 31) AS date_count")
def month_activity(spark, sf_dir):
    off = _offers(spark, sf_dir, *O.month_start(A.AS_OF))
    return O.month_activity(off, O.effective(off), A.AS_OF)


_FRIDAY = "DATE '2024-01-12'"


@query(with_(EFF, _days(_FRIDAY, 3), _FLOORS) + "SELECT days.date AS date, floor, coalesce(show_count, 0) AS show_count, floor IS NULL AS is_dark FROM days LEFT JOIN fl USING (date)")
def weekend_days(spark, sf_dir):
    return O.weekend_days(_eff(spark, sf_dir, A.AS_OF, 9), A.AS_OF)


@query(with_(EFF, _BEST) + f"SELECT date, row_number() OVER (PARTITION BY date ORDER BY price, show_ord) AS rank, show_id, time, price FROM best WHERE date >= {_FRIDAY} AND date < {_FRIDAY} + 3 QUALIFY rank <= 3")
def weekend_top3(spark, sf_dir):
    return O.weekend_top(_eff(spark, sf_dir, A.AS_OF, 9), A.AS_OF)


_MAT = f"m AS (SELECT *, date_trunc('week', date)::DATE AS week, split_part(time, ':', 1)::INT AS hour FROM eff WHERE date >= {D})"


@query(
    with_(
        EFF,
        _MAT,
        "x AS (SELECT week, show_id, show_ord, date, time, price FROM m WHERE hour < 17 QUALIFY row_number() OVER (PARTITION BY week, show_id ORDER BY price, date, time) = 1)",
        "e AS (SELECT week, show_id, min(price) AS evening_price FROM m WHERE hour >= 17 GROUP BY week, show_id)",
    )
    + "SELECT week, row_number() OVER (PARTITION BY week ORDER BY price, show_ord) AS rank, show_id, date, time, price, evening_price, CASE WHEN evening_price > price THEN floor(evening_price - price + 0.5::DOUBLE)::BIGINT END AS savings FROM x LEFT JOIN e USING (week, show_id) QUALIFY rank <= 8"
)
def matinee_rows(spark, sf_dir):
    return O.matinee_rows(_eff(spark, sf_dir, A.AS_OF), A.AS_OF)


_MON3 = "upper(strftime({}, '%b'))"
_WEEK_LABEL = "CASE WHEN month(week) = month(week + 6) THEN day(week) || '–' || day(week + 6) || ' ' || upper(strftime(week + 6, '%b')) ELSE day(week) || ' ' || upper(strftime(week, '%b')) || '–' || day(week + 6) || ' ' || upper(strftime(week + 6, '%b')) END"


@query(
    with_(EFF, _MAT, f"ws AS (SELECT ({D} - 2 + 7 * i::INT)::DATE AS week FROM range(60) t(i) WHERE {D} - 2 + 7 * i::INT <= (SELECT greatest(max(date), {D}) FROM offers))", "f AS (SELECT week, count(*) AS perf_count, min(price) AS floor FROM m WHERE hour < 17 GROUP BY week)")
    + f"SELECT week, coalesce(perf_count, 0) AS perf_count, floor, {_WEEK_LABEL} AS label FROM ws LEFT JOIN f USING (week)"
)
def matinee_weeks(spark, sf_dir):
    off = A.offers(spark, sf_dir)
    return O.matinee_weeks(O.effective(off), off, A.AS_OF)


def _tiers(days: int) -> str:
    best = f"b AS (SELECT show_id, show_ord, min(price) AS price FROM eff WHERE date >= {D} AND date < {D} + {days} GROUP BY show_id, show_ord)"
    tiers = "t AS (SELECT * FROM (VALUES (0, 'under20', 0.0::DOUBLE, 20.0::DOUBLE), (1, '20to30', 20.0, 30.0), (2, '30to40', 30.0, 40.0), (3, '40plus', 40.0, 'inf'::DOUBLE)) v(tier_ord, tier, lo, hi))"
    return with_(EFF, best, tiers) + "SELECT tier_ord, tier, count(show_id) AS show_count, arg_min(show_id, row(price, show_ord)) AS headline_show, min(price) AS headline_price FROM t LEFT JOIN b ON price >= lo AND price < hi GROUP BY tier_ord, tier"


@query(_tiers(30))
def price_tiers(spark, sf_dir):
    return O.price_tiers(_eff(spark, sf_dir, A.AS_OF, 30), A.AS_OF)


@query(_tiers(1))
def price_tiers_today(spark, sf_dir):
    """A single day, in which all tiers have shows."""
    return O.price_tiers(_eff(spark, sf_dir, A.AS_OF, 1), A.AS_OF, 1)


@query(
    with_(
        OFFERS,
        f"v AS (SELECT * FROM offers WHERE {VALID} AND date >= {D} AND date < {D} + 30)",
        "p AS (SELECT show_id, show_ord, date, time, arg_min(source, row(price_from, source_ord)) AS cheap_seller, min(price_from) AS cheap_price, arg_max(source, row(price_from, source_ord)) AS dear_seller, max(price_from) AS dear_price, count(*) AS sellers FROM v GROUP BY ALL)",
        "s AS (SELECT *, dear_price - cheap_price AS spread FROM p WHERE sellers >= 2 AND dear_price - cheap_price >= 5 QUALIFY row_number() OVER (PARTITION BY show_id ORDER BY spread DESC, date, time) = 1)",
    )
    + "SELECT row_number() OVER (ORDER BY spread DESC, show_ord) AS rank, show_id, date, time, cheap_seller, cheap_price, dear_seller, dear_price, spread, floor(spread / dear_price * 100 + 0.5::DOUBLE)::BIGINT AS pct, sellers FROM s QUALIFY rank <= 8"
)
def widest_spreads(spark, sf_dir):
    return S.widest_spreads(_offers(spark, sf_dir, A.AS_OF, 30), A.AS_OF)


_FUTURE_FLOOR = f"ff AS (SELECT show_id, min(price) AS floor FROM eff WHERE date >= {D} GROUP BY show_id)"


def _closing(days: int) -> str:
    runs = f"r AS (SELECT show_id, show_ord, max(date) AS last_date, count(*) AS remaining FROM perfs WHERE date >= {D} GROUP BY show_id, show_ord HAVING max(date) <= {D} + {days})"
    return with_(EFF, PERFS, _FUTURE_FLOOR, runs) + f"SELECT row_number() OVER (ORDER BY last_date - {D}, show_ord) AS rank, show_id, last_date, (last_date - {D})::INT AS days_left, remaining, floor, count(*) OVER () AS total_count FROM r JOIN ff USING (show_id) QUALIFY rank <= 8"


@query(_closing(30))
def closing_soon(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return O.closing_soon(O.effective(off), off, A.AS_OF)


@query(_closing(18))
def closing_within_18(spark, sf_dir):
    """A shorter horizon, which not every show of a month's table meets."""
    off = _offers(spark, sf_dir)
    return O.closing_soon(O.effective(off), off, A.AS_OF, 18)


@query(
    with_(
        EFF,
        PERFS,
        f"r AS (SELECT show_id, show_ord, min(date) AS first_date FROM perfs WHERE date >= {D} GROUP BY show_id, show_ord HAVING min(date) > {D} AND min(date) <= {D} + 21)",
        "g AS (SELECT show_id, show_ord, first_date, min(CASE WHEN date < first_date + 7 THEN price END) AS preview_floor, min(price) AS run_floor FROM r LEFT JOIN (SELECT show_id, date, price FROM eff WHERE date >= " + D + ") e USING (show_id) GROUP BY ALL)",
    )
    + f"SELECT row_number() OVER (ORDER BY first_date, show_ord) AS rank, show_id, first_date, (first_date - {D})::INT AS days_out, preview_floor, run_floor, CASE WHEN run_floor > preview_floor THEN floor(run_floor - preview_floor + 0.5::DOUBLE)::BIGINT END AS preview_savings, count(*) OVER () AS total_count FROM g QUALIFY rank <= 6"
)
def opening_soon(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return O.opening_soon(O.effective(off), off, A.AS_OF)


_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    with_(
        EFF,
        SHOWS,
        PERFS,
        _FUTURE_FLOOR,
        f"fu AS (SELECT show_id, count(*) FILTER (date < {D} + 7) AS week FROM perfs WHERE date >= {D} GROUP BY show_id)",
        "e AS (SELECT * FROM shows LEFT JOIN fu USING (show_id) LEFT JOIN ff USING (show_id))",
    )
    + f"SELECT row_number() OVER (ORDER BY count(week) > 0 DESC, count(*) DESC, venue) AS rank, {_SLUG.format('venue')} AS slug, venue AS display_name, count(*) AS show_count, count(week) AS active_count, min(floor) AS floor, coalesce(sum(week), 0)::BIGINT AS week_perfs FROM e GROUP BY venue"
)
def venues(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return S.venues(A.shows(spark, sf_dir), off, O.effective(off), A.AS_OF)


@query(
    with_(EFF, SHOWS, PERFS, _FUTURE_FLOOR, f"r AS (SELECT show_id, min(date) AS first_date, max(date) AS last_date, count(*) AS run_length FROM perfs WHERE date >= {D} GROUP BY show_id)")
    + f"SELECT show_id, title, floor, first_date, last_date, run_length FROM shows JOIN r USING (show_id) LEFT JOIN ff USING (show_id) WHERE {_SLUG.format('venue')} = '{VENUE}'"
)
def venue_detail(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return S.venue_detail(A.shows(spark, sf_dir), off, O.effective(off), A.AS_OF, VENUE)


_PICK = "p{0} AS (SELECT {0} AS pick, date, floor, perf_count FROM df WHERE {1} ORDER BY floor, date LIMIT 1)"


def _nights(days: int, near: int, middle: int, far: int) -> str:
    floors = f"df AS (SELECT date, min(price) AS floor, count(*) AS perf_count FROM eff WHERE date >= {D} AND date < {D} + {days} GROUP BY date)"
    wants = (
        f"date < {D} + {near}",
        f"date < {D} + {middle} AND isodow(date) >= 6 AND date NOT IN (SELECT date FROM p1)",
        f"date >= {D} + {middle} AND date < {D} + {far} AND date NOT IN (SELECT date FROM p1 UNION ALL SELECT date FROM p2)",
        f"date >= {D} + {middle} AND isodow(date) <= 4 AND date NOT IN (SELECT date FROM p1 UNION ALL SELECT date FROM p2 UNION ALL SELECT date FROM p3)",
    )
    return with_(EFF, floors, *[_PICK.format(i + 1, w) for i, w in enumerate(wants)]) + "SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4"


@query(_nights(90, 14, 30, 60))
def best_nights(spark, sf_dir):
    return O.best_nights(_eff(spark, sf_dir, A.AS_OF, 90), A.AS_OF)


@query(_nights(60, 5, 10, 15))
def best_nights_near(spark, sf_dir):
    """With horizons that suit a table of one month."""
    return O.best_nights(_eff(spark, sf_dir, A.AS_OF, 60), A.AS_OF, days=60, near=5, middle=10, far=15)


@query(
    with_(
        EFF,
        f"df AS (SELECT date, min(price) AS floor FROM eff WHERE date >= {D} AND date < {D} + 60 GROUP BY date)",
        "c AS (SELECT (isodow(date) - 1)::INT AS dow, list_sort(list(floor)) AS p FROM df GROUP BY 1)",
        "k AS (SELECT dow, p[len(p) // 2 + 1] AS median, p[1] AS low, p[-1] AS high, len(p) AS n, p[-1] - p[1] AS spread FROM c)",
        "w AS (SELECT min(median) AS least, arg_max(dow, row(spread, -dow)) AS widest FROM k)",
    )
    + "SELECT r.i::INT AS dow, median, low, high, coalesce(n, 0)::INT AS n, coalesce(median <= least + 2, false) AS cheap, coalesce(dow = w.widest, false) AS widest FROM range(7) r(i) LEFT JOIN k ON r.i = k.dow, w"
)
def weekday_distribution(spark, sf_dir):
    return O.weekday_distribution(_eff(spark, sf_dir, A.AS_OF, 60), A.AS_OF)


@query(
    with_(EFF, _days(_MONTH, 121), f"fl AS (SELECT date, min(price) AS floor, count(*) AS perf_count FROM eff WHERE date >= {D} AND date < {D} + 90 GROUP BY date)", f"cuts AS ({cuts('floor', 'fl')})")
    + f"SELECT days.date AS date, days.date >= {D} AND days.date < {D} + 90 AS in_window, floor, coalesce(perf_count, 0) AS perf_count, CASE WHEN floor IS NOT NULL THEN {bucket('floor')} END AS bucket, days.date >= {D} AND days.date < {D} + 90 AND floor IS NULL AS is_dark FROM days LEFT JOIN fl USING (date), cuts"
)
def monthly_calendar(spark, sf_dir):
    return O.monthly_calendar(_eff(spark, sf_dir, A.AS_OF, 90), A.AS_OF)


@query(
    with_(
        EFF,
        SHOWS,
        PERFS,
        f"r AS (SELECT show_id, min(date) AS f, max(date) AS l, count(*) AS n FROM perfs WHERE date >= {D} GROUP BY show_id)",
        f"p AS (SELECT show_id, min(price) AS floor, count(*) AS priced, count(*) FILTER (seller_count = 1) AS single FROM eff WHERE date >= {D} GROUP BY show_id)",
    )
    + f"SELECT show_id, l <= {D} + 30 AS closing_soon, f > {D} AND f <= {D} + 21 AS opening_soon, n < 30 AS limited, coalesce(priced > 0 AND single = priced, false) AS exclusive, coalesce(floor <= 25 AND source_count <= 2, false) AS hidden_gem FROM r JOIN shows USING (show_id) LEFT JOIN p USING (show_id)"
)
def show_filters(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return S.show_filters(A.shows(spark, sf_dir), off, O.effective(off), A.AS_OF)


@query(
    with_(OFFERS, SHOWS, "c AS (SELECT source_count AS sellers, count(*) AS show_count FROM shows GROUP BY 1)", "t AS (SELECT sum(show_count)::BIGINT AS total, coalesce(sum(show_count) FILTER (sellers >= 3), 0)::BIGINT AS well_covered FROM c)")
    + "SELECT sellers, show_count, total, well_covered, floor(show_count / total * 100 + 0.5::DOUBLE)::BIGINT AS pct FROM c, t"
)
def coverage(spark, sf_dir):
    return S.coverage(A.shows(spark, sf_dir))


@query(
    with_(OFFERS, SHOWS)
    + f"SELECT (SELECT count(*) FROM shows) AS show_count, (SELECT count(*) FROM shows WHERE NOT coalesce(min_price > 0, false)) AS price_tbc_count, (SELECT count(*) FROM (SELECT DISTINCT show_id, date, time FROM offers)) AS perf_count, (SELECT count(*) FROM offers) AS offer_count, (SELECT count(DISTINCT source) FROM offers) AS seller_count"
)
def methodology(spark, sf_dir):
    return S.methodology(A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("show_id")), A.offers(spark, sf_dir))


@query(
    with_(OFFERS, f"w AS (SELECT show_id, show_ord, arg_min(source, row(price_from, source_ord)) AS seller FROM offers WHERE {VALID} GROUP BY show_id, show_ord, date, time)", "c AS (SELECT seller, show_id, show_ord, count(*) AS wins FROM w GROUP BY ALL)")
    + "SELECT seller, row_number() OVER (PARTITION BY seller ORDER BY wins DESC, show_ord) AS rank, show_id, wins FROM c QUALIFY rank <= 20"
)
def seller_wins(spark, sf_dir):
    return S.seller_wins(A.offers(spark, sf_dir))


@query(with_(OFFERS) + f"SELECT source, count(DISTINCT show_id) AS show_count, count(*) AS offer_count, count(DISTINCT CASE WHEN {VALID} THEN show_id END) AS priced_show_count FROM offers GROUP BY source")
def seller_shows(spark, sf_dir):
    return S.seller_shows(A.offers(spark, sf_dir))


@query(
    with_(OFFERS, f"v AS (SELECT *, min(price_from) OVER (PARTITION BY show_id, date, time) AS least FROM offers WHERE {VALID})")
    + "SELECT show_id, source, count(*) FILTER (price_from = least) AS cheapest_count, min(price_from) AS best_price, count(*) AS total_count FROM v GROUP BY show_id, source"
)
def scoreboard(spark, sf_dir):
    return S.scoreboard(A.offers(spark, sf_dir))


@query(with_(OFFERS) + f"SELECT show_id, coalesce(min(price_from) FILTER ({VALID}), 0) AS axis_min, coalesce(max(price_from) FILTER ({VALID}), 0) AS axis_max FROM offers GROUP BY show_id")
def price_axis(spark, sf_dir):
    return S.price_axis(A.offers(spark, sf_dir))


@query(
    with_(
        OFFERS,
        f"v AS (SELECT * FROM offers WHERE {VALID} AND date = {D})",
        "g AS (SELECT show_id, time, price_from AS price, string_agg(source, ',' ORDER BY source_ord) AS sellers FROM v GROUP BY show_id, time, price_from)",
        "b AS (SELECT show_id, time, min(price_from) AS lo, max(price_from) AS hi FROM v GROUP BY show_id, time)",
    )
    + "SELECT show_id, time, price, sellers, CASE WHEN hi > lo THEN (price - lo) / (hi - lo) * 100 ELSE 50 END::DOUBLE AS position FROM g JOIN b USING (show_id, time)"
)
def spread_groups(spark, sf_dir):
    return S.equal_prices(_offers(spark, sf_dir, A.AS_OF, 1), A.AS_OF)


@query(
    with_(OFFERS, SHOWS, "u AS (SELECT show_id, source, min(book_url) AS other_url FROM offers WHERE book_url IS NOT NULL GROUP BY show_id, source)")
    + f"SELECT o.show_id AS show_id, time, row_number() OVER (PARTITION BY o.show_id, time ORDER BY price_from, source_ord) AS rank, o.source AS source, price_from AS price, coalesce(book_url, other_url, 'https://search.example/?q=' || regexp_replace(title, '[^A-Za-z0-9]+', '+', 'g')) AS url FROM offers o JOIN shows s ON o.show_id = s.show_id LEFT JOIN u ON o.show_id = u.show_id AND o.source = u.source WHERE {VALID} AND date = {D}"
)
def seller_rows(spark, sf_dir):
    return S.seller_rows(A.offers(spark, sf_dir), A.shows(spark, sf_dir), A.AS_OF)


@query(with_(EFF, PERFS) + f"SELECT p.time AS time, p.show_id AS show_id, seller, price FROM perfs p LEFT JOIN eff e ON p.show_id = e.show_id AND p.date = e.date AND p.time = e.time WHERE p.date = {D}")
def today_feed(spark, sf_dir):
    off = _offers(spark, sf_dir, A.AS_OF, 1)
    return O.today_feed(off, O.effective(off), A.AS_OF)


_FILTERED = f"SELECT show_id FROM perfs WHERE date >= {D} GROUP BY show_id HAVING count(*) < 30"


@query(with_(EFF, SHOWS, PERFS, _FUTURE_FLOOR) + f"SELECT show_id, title, venue, floor FROM shows LEFT JOIN ff USING (show_id) WHERE (contains(lower(title), 'ion_1') OR contains(lower(venue), 'ion_1')) AND show_id IN ({_FILTERED})")
def search(spark, sf_dir):
    off, shows = _offers(spark, sf_dir), A.shows(spark, sf_dir)
    eff = O.effective(off)
    return S.search(shows, S.show_filters(shows, off, eff, A.AS_OF), eff, A.AS_OF, " ION_1 ", "limited")


@query(
    with_(EFF, f"f AS (SELECT show_id, date, min(price) AS lo, max(price) AS hi FROM eff WHERE date >= {D} GROUP BY show_id, date)", "o AS (SELECT a.show_id, a.date, min(b.lo) AS other_low, max(b.hi) AS other_high FROM f a LEFT JOIN f b ON a.show_id = b.show_id AND a.date <> b.date GROUP BY a.show_id, a.date)")
    + f"SELECT show_id, date, other_low, other_high, {label('other_low', 'other_high')} AS label FROM o"
)
def other_dates_range(spark, sf_dir):
    return O.other_dates(_eff(spark, sf_dir, A.AS_OF), A.AS_OF)


@query(
    with_(
        EFF,
        PERFS,
        f"d AS (SELECT show_id, date, CASE WHEN count(DISTINCT time) > 2 THEN count(DISTINCT time) || ' PERFS' ELSE string_agg(DISTINCT time, ', ' ORDER BY time) END AS times FROM perfs WHERE date >= {D} GROUP BY show_id, date)",
        f"fl AS (SELECT show_id, date, min(price) AS floor FROM eff WHERE date >= {D} GROUP BY show_id, date)",
        "l AS (SELECT show_id, list_sort(list(floor)) AS p FROM fl GROUP BY show_id)",
        "c AS (SELECT show_id, " + ", ".join(f"p[least(len(p) - 1, floor(len(p) * {q}::DOUBLE)::INT) + 1] AS c{i + 1}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8))) + " FROM l)",
    )
    + f"SELECT show_id, date, floor, CASE WHEN floor IS NOT NULL THEN {bucket('floor')} END AS bucket, times FROM d LEFT JOIN fl USING (show_id, date) LEFT JOIN c USING (show_id)"
)
def show_month_grid(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return O.month_grid(O.effective(off), off, A.AS_OF)


# --- defaults and labels of views


@query(with_(OFFERS, PERFS) + f"SELECT show_id, coalesce(min(date) FILTER (date >= {D}), max(date)) AS date FROM perfs GROUP BY show_id")
def default_dates(spark, sf_dir):
    return V.default_dates(A.offers(spark, sf_dir), A.AS_OF)


@query(with_(EFF, _days(D, 7)) + "SELECT coalesce((SELECT date FROM days WHERE date = " + D + "), (SELECT min(date) FROM eff JOIN days USING (date)), (SELECT min(date) FROM days)) AS date")
def default_week_day(spark, sf_dir):
    return V.default_day(O.week_days(_eff(spark, sf_dir, A.AS_OF, 7), A.AS_OF), A.AS_OF)


@query(with_(EFF, _days(f"{D} + 14", 14)) + "SELECT show_id, (SELECT min(date) FROM eff f JOIN days USING (date) WHERE f.show_id = e.show_id) AS date FROM eff e WHERE date >= " + D + " + 14 AND date < " + D + " + 28 GROUP BY show_id")
def default_lit_days(spark, sf_dir):
    """For each show, the first day of a fortnight without today that has an offer."""
    start = A.AS_OF + datetime.timedelta(days=14)
    days = _eff(spark, sf_dir, start, 14).where(F.col("date") < O.lit_date(start + datetime.timedelta(days=14)))
    return days.groupBy("show_id").agg(V.first_lit(F.col("date"), F.lit(False), A.AS_OF).alias("date"))


@query(with_(OFFERS, SHOWS) + f"SELECT venue AS display_name, count(*) AS show_count FROM shows WHERE contains(lower(venue), 'nation_1') GROUP BY venue")
def venue_search(spark, sf_dir):
    off = _offers(spark, sf_dir)
    return V.venue_search(S.venues(A.shows(spark, sf_dir), off, O.effective(off), A.AS_OF), " Nation_1 ").select("display_name", "show_count")


@query(
    with_(EFF, f"f AS (SELECT date, isodow(date)::INT - 1 AS dow, floor(min(price)) AS floor FROM eff WHERE date >= {D} GROUP BY date)")
    + "SELECT date, dow, floor, ((row_number() OVER (PARTITION BY dow, floor ORDER BY date) - 1) - (count(*) OVER (PARTITION BY dow, floor) - 1) / 2.0::DOUBLE) * 5 AS offset FROM f"
)
def floor_swarm(spark, sf_dir):
    floors = O.day_floors(_eff(spark, sf_dir, A.AS_OF).where(F.col("date") >= O.lit_date(A.AS_OF))).select("date", F.weekday("date").alias("dow"), F.floor("floor").cast("double").alias("floor"))
    return V.swarm(floors, "dow", "floor", "date")


@query(
    with_(
        OFFERS,
        f"v AS (SELECT * FROM offers WHERE {VALID} AND date >= {D} AND date < {D} + 30)",
        "p AS (SELECT show_id, show_ord, date, time, max(price_from) - min(price_from) AS spread FROM v GROUP BY ALL HAVING count(*) >= 2 AND max(price_from) - min(price_from) >= 5)",
        "b AS (SELECT show_id, show_ord, max(spread) AS spread FROM p GROUP BY ALL ORDER BY spread DESC, show_ord LIMIT 8)",
    )
    + "SELECT show_id, spread, greatest(8::DOUBLE, spread / (SELECT max(spread) FROM b) * 100) AS width FROM b"
)
def spread_bars(spark, sf_dir):
    return V.bar_widths(S.widest_spreads(_offers(spark, sf_dir, A.AS_OF, 30), A.AS_OF).select("show_id", "spread"), "spread")


@query(
    with_(OFFERS, PERFS, f"r AS (SELECT show_id, min(date) - {D} AS days_out, max(date) - {D} AS days_left FROM perfs WHERE date >= {D} GROUP BY show_id)")
    + "SELECT show_id, CASE WHEN days_left = 0 THEN 'final' WHEN days_left <= 7 THEN 'critical' ELSE '' END AS badge, CASE days_out WHEN 0 THEN 'OPENS TODAY' WHEN 1 THEN 'OPENS TOMORROW' ELSE 'OPENS IN ' || days_out || ' DAYS' END AS opening FROM r"
)
def run_badges(spark, sf_dir):
    day = O.lit_date(A.AS_OF)
    runs = _offers(spark, sf_dir).where(F.col("date") >= day).groupBy("show_id").agg(F.date_diff(F.min("date"), day).alias("days_out"), F.date_diff(F.max("date"), day).alias("days_left"))
    return runs.select("show_id", V.closing_badge(F.col("days_left")).alias("badge"), V.opening_label(F.col("days_out")).alias("opening"))


_MONEY = "CASE WHEN {0} = floor({0}) THEN '£' || floor({0})::BIGINT ELSE '£' || printf('%.2f', {0}) END"


@query(
    with_(OFFERS, f"a AS (SELECT show_id, min(price_from) AS lo, max(price_from) AS hi FROM offers WHERE {VALID} GROUP BY show_id)")
    + f"SELECT show_id, CASE WHEN lo = hi THEN {_MONEY.format('lo')} ELSE {_MONEY.format('lo')} || '–' || {_MONEY.format('hi')} END AS label FROM a"
)
def price_labels(spark, sf_dir):
    return S.price_axis(A.offers(spark, sf_dir)).where("axis_min > 0").select("show_id", V.range_text(F.col("axis_min"), F.col("axis_max")).alias("label"))


@query(with_(OFFERS) + f"SELECT DISTINCT show_id, year(date)::INT AS year, month(date)::INT AS month FROM offers WHERE date >= {D}")
def months_needed(spark, sf_dir):
    return V.months_needed(_offers(spark, sf_dir), A.AS_OF)


@query("SELECT c, y AS year, m AS month FROM (SELECT o_custkey AS c, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), month(o_orderdate)) AS n FROM (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1995-01-01')) WHERE n <= 6")
def months_capped(spark, sf_dir):
    """The limit of six months, on orders of many years."""
    orders = A.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("show_id"), F.to_date("o_orderdate").alias("date"))
    return V.months_needed(orders, datetime.date(1995, 1, 1)).select(F.col("show_id").alias("c"), "year", "month")


@query(with_(OFFERS, PERFS, SHOWS) + "SELECT '' AS generated_at, (SELECT count(*) FROM shows) AS show_count, (SELECT count(*) FROM perfs) AS performance_count")
def export_meta(spark, sf_dir):
    return V.meta(A.shows(spark, sf_dir), A.offers(spark, sf_dir).select(*O.PERF).distinct(), None)
