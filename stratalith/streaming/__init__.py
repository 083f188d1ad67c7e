"""Structured Streaming: the epoch aggregates kept up to date as scenes arrive."""
