"""From raw documents to packed training sequences, in stages that each call one operator.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last give the columns of ``documents``, whatever their names.

Rows with a null doc_id stay in every stage up to the last, unless they are toxic; they are no copies
of others. A null text is empty from the first stage that looks at it; empty texts are near copies of
each other, so one of them stays. Rows that repeat a doc_id are one document to the stages on lines
and passages and rows of their own to the others. Ties go to the smaller doc_id. An empty table stays
one, without pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.common import Scratch, quoted, read_table
from stratalith.llm.line_dedup import dedup_lines
from stratalith.llm.packing import pack
from stratalith.llm.simhash import keep_one
from stratalith.llm.suffix_dedup import drop_repeats
from stratalith.llm.toxicity import toxicity
from stratalith.sources.scratch import temporary


def _with_new_text(out: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents; ``n_chars`` counts the new text."""
    return out.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else quoted(c) for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Without labels of both kinds none does."""
    return toxicity(docs, read_table(spark, sf_dir, "labels")).where(~F.col("toxic")).select(*map(quoted, docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest doc_id."""
    return _with_new_text(dedup_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first place, by doc_id and position."""
    return _with_new_text(drop_repeats(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_common_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Tokenising, fingerprints and a trained model are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows. What a stage writes on its way goes with its end."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with temporary():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
