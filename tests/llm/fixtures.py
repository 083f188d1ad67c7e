"""Small tables of documents with the awkward cases, and digests."""

import struct

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, task string, hi long, digest string, row string"

LONG = "very long text with many words " * 20_000

TEXTS = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "One common line here\nand another one\nshort",
    "  one COMMON line here \nsomething else entirely\nshort",
    "Ünïcode café naïve 日本語 テスト İstanbul ΣΊΣΥΦΟΣ",
    "it's they've I'm we'll he'd x'st '''s don't!!! a1b2c3 <|endoftext|> <|startoftext|>tail",
    "control \x1c\x1d chars \x85 and   nbsp ​ zero",
    LONG,
    LONG + "!",
    "Same text again",
    "Same  text\nagain",
    "Same text again",
    "é combining ́alone",
    "\n\n\n",
    "👍🏽 emoji 👨‍👩‍👧‍👦 family",
]


def rows(texts=TEXTS, first=10):
    return [(first + i, t, "en", "src", len(t or ""), "x", 1, "d", "r") for i, t in enumerate(texts)]


def documents(spark, texts=TEXTS, extra=()):
    """The texts under ascending ids, then rows (doc_id, text): null ids, repeated ids."""
    return spark.createDataFrame(rows(texts) + [(i, t, None, None, None, None, None, None, None) for i, t in extra], SCHEMA)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
