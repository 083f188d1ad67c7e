"""Queries: operators bound to tables, each with its equivalent in DuckDB's SQL."""
