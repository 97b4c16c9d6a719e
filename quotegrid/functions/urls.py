"""Addresses: cleaning, parts, and the ones that sellers' pages have."""

from __future__ import annotations

from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEAT_PATH = "/shows/seats/"


def clean(url: Column, path: str = SEAT_PATH) -> Column:
    """Without query and fragment where the address holds a path; others as they are."""
    return F.when(url.contains(path), F.regexp_replace(url, r"(?s)[?#].*$", "")).otherwise(url)


def slug_of(url: Column) -> Column:
    """The last part of the path; null without one."""
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/+$", "")
    return F.nullif(F.regexp_extract(path, r"^[^:]+://[^/]+/(?:.*/)?([^/]+)$", 1), F.lit(""))


def id_and_slug(url: Column) -> tuple[Column, Column]:
    """The number and the name of ``.../123-a-name`` or ``.../123/a-name``; nulls otherwise."""
    pattern = r"/(\d+)[-/]([^/?#]+)/?(?:[?#].*)?$"
    return F.regexp_extract(url, pattern, 1).try_cast("long"), F.nullif(F.regexp_extract(url, pattern, 2), F.lit(""))


def fragment_id(url: Column) -> Column:
    """The digits at the end of a fragment."""
    return F.nullif(F.regexp_extract(url, r"#[^#]*?(\d+)$", 1), F.lit(""))


def last_number(url: Column) -> Column:
    """The number that ends the path."""
    return F.regexp_extract(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"/(\d+)/?$", 1).try_cast("long")


def date_segment(date: Column) -> Column:
    """``21-may-2026``"""
    return F.lower(F.date_format(date, "d-MMM-yyyy"))


def time_segment(time: Column) -> Column:
    """``2-00pm`` from ``14:00``; null if it isn't a time."""
    h, m = F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 1).try_cast("int"), F.regexp_extract(time, r"^(\d{1,2}):(\d{2})", 2).try_cast("int")
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.when((h < 24) & (m < 60), F.concat(twelve.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.when(h < 12, "am").otherwise("pm")))


def ticket_page(show_url: Column, date: Column, time: Column) -> Column:
    """A performance's page under a show's; null if a part is missing."""
    base = F.when(F.endswith(show_url, F.lit("/")), show_url).otherwise(F.concat(show_url, F.lit("/")))
    return F.when(show_url != "", F.concat(base, F.lit("tickets/"), date_segment(date), F.lit("/"), time_segment(time), F.lit("/")))


def booking_query(base: str, show_id: Column, showtime_id: Column, date: Column, time: Column, quantity: int = 2) -> Column:
    """A booking address with its query; date and slot only where known; null without a showtime."""
    query = F.concat_ws("&", F.concat(F.lit("product_id="), show_id.cast("string")), F.lit(f"qt={quantity}"), F.concat(F.lit("showtime_id="), showtime_id.cast("string")), F.concat(F.lit("date="), F.nullif(F.url_encode(date.cast("string")), F.lit(""))), F.concat(F.lit("slot="), F.nullif(F.url_encode(time), F.lit(""))))
    return F.when(showtime_id.isNotNull(), F.concat(F.lit(base + "?"), query))


def _ascii(url: str) -> str:
    p = urlsplit(url)
    return urlunsplit((p.scheme, p.netloc, quote(p.path, safe="/-_.~%"), quote(p.query, safe="=&%"), p.fragment))


@F.pandas_udf(T.StringType())
def ascii_safe(url: pd.Series) -> pd.Series:
    """Path and query percent-encoded where they aren't ASCII; what is encoded stays; null and empty pass."""
    return url.map(lambda u: _ascii(u) if u else u, na_action="ignore")
