"""The canonical tables as schemas, and how a table is brought into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCRAPE = "source string, source_ord int, scraped_at string, show_count int, performance_count int, report struct<warnings: array<string>, failures: array<struct<key: string, reason: string>>, tag_list_counts: map<string, int>>"
RECORD = "rec_id long, source string, source_id string, title_raw string, venue_raw string, url string, description string, title_norm string, venue_norm string, venue_canonical string, matched_via string"
OFFER = "show_id long, show_ord long, date date, time string, source string, source_ord int, price_from double, price_to double, currency string, book_url string, available boolean"
PERFORMANCE = "show_id long, show_ord long, date date, time string, min_price double, max_price double, currency string, any_available boolean"
SHOW = "show_id string, show_ord long, title string, venue string, title_norm string, venue_norm string, source_count long, description string, min_price double, max_price double, performance_count long, field_provenance map<string, string>, match_confidence int"
CACHE = "key string, hash string, stored_at timestamp, value double"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order and types: those that are missing are
    null, others are dropped, and values that don't fit become null."""
    out = []
    for f in T._parse_datatype_string(schema).fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
    return df.select(*out)
