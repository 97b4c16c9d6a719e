"""All named queries (``QUERIES``) and their DuckDB SQL (``SQL``)."""

from . import analytics, extraction, lookups, pipeline, steps  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
