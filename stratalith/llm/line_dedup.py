"""Line dedup: lines whose normalised form stands in several documents stay in one of them.

Each document sends the 128-bit hash of each of its distinct long keys once. An aggregate with
map-side partial results finds, for each hash, the smallest and the largest doc_id: a key stands
in at least two documents exactly if these differ, however many copies there are, so no list of a
common line's documents is ever built. The hashes that a document loses come back to it, and its
lines are put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_SPACE, Scratch, pieces, ship, text_and_rest, with_names

MIN_KEY_CHARS = 10
#: Documents that must have a key.
MIN_DOCUMENTS = 2

NEW = ["n_lines", "n_dropped"]
_FIELDS = "text string, n_lines bigint, n_dropped bigint"


def _key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased; other letters stay as they are."""
    return line.strip(ASCII_SPACE).lower()


def _digests(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None where it is too short."""
    from xxhash import xxh3_128_digest

    out: list[bytes | None] = []
    for line in lines:
        key = _key(line)
        long_enough = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars
        out.append(xxh3_128_digest(key) if long_enough else None)
    return out


def line_hashes(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``hi, lo, doc_id``: a row for each document and distinct long key."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches):
            digests, owners = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = set(_digests(text.encode("utf-8", "replace").split(b"\n"), min_chars)) - {None}
                digests += own
                owners += [doc_id] * len(own)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(owners, pa.int64())], ["hi", "lo", "doc_id"])

    return docs.mapInArrow(run, "hi long, lo long, doc_id long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Drop repeated lines; ``docs`` with a new ``text`` and with ``n_lines`` and ``n_dropped``.

    docs needs ``doc_id`` and ``text``; its other columns stay, whatever their names, save that
    columns named ``n_lines`` or ``n_dropped``, in any letter case, are replaced. A null or empty text is
    one empty line and becomes the empty text. Keys of at least ``min_chars`` code points that stand in
    ``min_documents`` documents or more lose all their lines but those of the smallest doc_id; a key that
    repeats inside one document alone stays. Rows with a null doc_id are no documents: they keep all
    their lines and count for no other. Rows that repeat a doc_id are one document: what it loses is
    lost in each of them. An empty table gives no rows.
    """
    if min_documents < 2:
        raise ValueError("min_documents must be two at least")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    columns = docs.columns
    docs, names = text_and_rest(docs, tuple(NEW))
    docs = docs.withColumn("key", F.col("doc_id").cast("long"))
    ided = docs.where("key is not null").select(F.col("key").alias("doc_id"), "text")
    hashes = scratch.keep(line_hashes(ided, min_chars), "hashes")
    if min_documents == 2:
        # The least and the greatest doc_id tell whether there are two; both aggregate before the shuffle.
        common = hashes.groupBy("hi", "lo").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").drop("last")
    else:
        # Each document counts once: its rows of a key become one before the key's are counted.
        common = hashes.distinct().groupBy("hi", "lo").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_documents).drop("n")
    common = scratch.keep(common, "common", rows=hashes.count(), per_file=500_000)
    lost = hashes.join(common, ["hi", "lo"]).where("doc_id > keeper").groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))
    joined = docs.join(lost.withColumnRenamed("doc_id", "key"), "key", "left").drop("key")
    passed = docs.drop("text", "key").schema
    schema = StructType([*passed.fields, *StructType.fromDDL(_FIELDS).fields])

    def drop(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                if gone is None:
                    texts.append(text)
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {np.array([x["hi"], x["lo"]], dtype="<i8").tobytes() for x in gone}
                lines = text.encode("utf-8", "replace").split(b"\n")
                kept = [line for line, digest in zip(lines, _digests(lines, min_chars), strict=True) if digest not in gone]
                texts.append(b"\n".join(kept).decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed.names), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*passed.names, "text", *NEW])

    return with_names(joined.mapInArrow(drop, schema), names, NEW, columns)
