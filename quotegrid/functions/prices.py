"""Price expressions: validity, percentiles, buckets, labels, and prices in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and bounds.
MONEY = r"£?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
POUND_PRICE = r"£\s*([0-9]+(?:[.,][0-9]{1,2})?)"
VISIBLE_BOUNDS = (5.0, 600.0)
TICKET_BOUNDS = (4.0, 500.0)
PERCENTILES = (0.2, 0.4, 0.6, 0.8)


def valid_price(price: Column) -> Column:
    """Whether a price is known: a finite number above 0. Never null."""
    return F.coalesce((price > 0) & ~F.isnan(price) & (price < F.lit(float("inf"))), F.lit(False))


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5))


def nearest_rank(values: Column, p: float) -> Column:
    """Of an ascending array, the element at floor(n * p), the last at most; null if empty."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1
    return F.when(n > 0, F.try_element_at(values, F.greatest(at, F.lit(1))))


def cut_points(values: Column) -> Column:
    """The four nearest-rank percentiles of an array, in order."""
    ordered = F.array_sort(values)
    return F.array(*[nearest_rank(ordered, p) for p in PERCENTILES])


def bucket(price: Column, cuts: Column) -> Column:
    """1 to 5 by four cut points; 5 if the price or a cut is null."""
    out = F.lit(5)
    for i in (3, 2, 1, 0):
        out = F.when(price <= cuts[i], i + 1).otherwise(out)
    return out


def format_price(price: Column) -> Column:
    """Pounds: whole ones without pence; a dash where the price isn't valid."""
    text = F.when(price == F.floor(price), F.format_string("£%d", F.floor(price))).otherwise(F.format_string("£%.2f", price))
    return F.when(valid_price(price), text).otherwise("—")


def range_label(low: Column, high: Column) -> Column:
    """``£a–£b``, or ``£a`` if both round alike; null if a bound isn't valid."""
    a, b = js_round(low).cast("string"), js_round(high).cast("string")
    return F.when(valid_price(low) & valid_price(high), F.when(low == high, F.concat(F.lit("£"), a)).otherwise(F.concat(F.lit("£"), a, F.lit("–£"), b)))


def parse_money(text: Column) -> Column:
    """The first amount in a text, thousands commas left out; null without one."""
    return _number(F.regexp_extract(text, MONEY, 1))


def _number(found: Column) -> Column:
    cleaned = F.regexp_replace(found, ",", "")
    return F.when(cleaned != "", cleaned.try_cast("double"))


def pound_price(text: Column, comma_is_point: bool = False) -> Column:
    """The first ``£`` price. A decimal comma is accepted by the pattern, but
    counts as a number only where ``comma_is_point``."""
    found = F.regexp_extract(text, POUND_PRICE, 1)
    return F.when(found != "", (F.regexp_replace(found, ",", ".") if comma_is_point else found).try_cast("double"))


def all_pound_prices(text: Column, bounds: tuple[float, float] = VISIBLE_BOUNDS) -> Column:
    """All ``£`` amounts of a text within bounds, distinct and ascending; empty for null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(POUND_PRICE), 1), lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= bounds[0]) & (x <= bounds[1]))))


def ticket_tiers(html: Column, bounds: tuple[float, float] = TICKET_BOUNDS) -> Column:
    """Prices of the rows of a ticket table (class ``ticket``, attribute
    ``data-cost``) within bounds and not sold out, in order; rows without a cost are no tiers."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*class=\"[^\"]*\bticket\b[^\"]*\"[^>]*>.*?</tr>"), 0)
    open_ = F.filter(rows, lambda r: ~F.lower(r).contains("sold out"))
    costs = F.transform(open_, lambda r: F.regexp_extract(r, r'data-cost="([0-9.]+)"', 1).try_cast("double"))
    return F.filter(costs, lambda x: (x >= bounds[0]) & (x <= bounds[1]))


def stock_state(states: Column) -> Column:
    """Tri-state availability of an array of texts: any in stock, else any sold out, else null."""
    return F.when(F.exists(states, lambda x: x.contains("InStock")), True).when(F.exists(states, lambda x: x.contains("SoldOut") | x.contains("OutOfStock")), False)
