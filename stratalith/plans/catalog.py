"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from . import features, segments

QUERIES = features.QUERIES | segments.QUERIES
SQL = features.SQL | segments.SQL
