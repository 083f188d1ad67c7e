"""Training-data operators: search, tokenisation, deduplication, filtering and packing.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries
only when it can be imported.
"""
