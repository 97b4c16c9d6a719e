"""Named queries: a Spark function and, where SQL can say it, DuckDB SQL over the same tables.

The SQL is an independent statement of the same result, for comparison only;
its common parts are the CTEs below.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import AS_OF, SELLERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


D = f"DATE '{AS_OF}'"
_RANK = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SELLERS))

SEEN = f"""seen AS (SELECT event_id AS seq, user_id AS show_id, user_id AS show_ord, ts::DATE AS date, CASE WHEN hour(ts) < 17 THEN '14:30' ELSE '19:30' END AS time, event_type AS source,
  CASE event_type {_RANK} END AS source_ord, value AS price_from, (props::JSON->>'k')::INT AS k, ts AS seen_at FROM events)"""
OFFERS = f"""{SEEN},
offers AS (SELECT show_id, show_ord, date, time, source, source_ord, price_from, CASE WHEN k % 4 = 0 THEN price_from * 1.5::DOUBLE END AS price_to, 'GBP' AS currency,
  CASE WHEN k % 3 <> 0 THEN 'https://' || source || '.example/' || show_id END AS book_url, CASE WHEN k < 10 THEN false WHEN k < 80 THEN true END AS available
  FROM seen QUALIFY row_number() OVER (PARTITION BY show_id, date, time, source ORDER BY seq DESC) = 1)"""
VALID = "(price_from > 0 AND NOT isnan(price_from) AND price_from < 'inf'::DOUBLE)"
EFF = f"""{OFFERS},
eff AS (SELECT show_id, show_ord, date, time, arg_min(source, row(price_from, source_ord)) AS seller, min(price_from) AS price, count(*) AS seller_count
  FROM offers WHERE {VALID} AND coalesce(available, true) GROUP BY ALL)"""
SHOWS = """shows AS (SELECT c_custkey AS show_id, c_custkey AS show_ord, c_name AS title, n_name AS venue, lower(n_name) AS venue_norm, source_count, min_price, max_price
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT show_id, min(price_from) AS min_price, coalesce(max(price_to), max(price_from)) AS max_price, count(DISTINCT source) AS source_count FROM offers GROUP BY show_id) o ON c_custkey = o.show_id)"""
PERFS = "perfs AS (SELECT DISTINCT show_id, show_ord, date, time FROM offers)"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


def cuts(column: str, table: str) -> str:
    """The four nearest-rank percentiles of a column, as c1 to c4."""
    at = lambda p: f"p[least(len(p) - 1, floor(len(p) * {p}::DOUBLE)::INT) + 1]"
    return f"SELECT {', '.join(f'{at(p)} AS c{i + 1}' for i, p in enumerate((0.2, 0.4, 0.6, 0.8)))} FROM (SELECT list_sort(list({column})) AS p FROM {table} WHERE {column} IS NOT NULL)"


def bucket(price: str) -> str:
    return reduce(lambda rest, i: f"CASE WHEN {price} <= c{i} THEN {i} ELSE {rest} END", (4, 3, 2, 1), "5")


def label(low: str, high: str) -> str:
    a, b = f"floor({low} + 0.5::DOUBLE)::BIGINT", f"floor({high} + 0.5::DOUBLE)::BIGINT"
    return f"CASE WHEN {low} > 0 AND {high} > 0 THEN CASE WHEN {low} = {high} THEN '£' || {a} ELSE '£' || {a} || '–£' || {b} END END"
