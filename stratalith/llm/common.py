"""What the operators share: small column helpers, and the tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, checkpoint_root, ship  # noqa: F401  the operators take them from here

#: Rows that an operator turns into Python objects at a time. Texts may be long, so these are few.
ARROW_ROWS = 512

#: The white space that the text contracts name: ``[\x20\x09-\x0D]``.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Words of 64 bits that a filter of ids has at most: 32 MB, whatever the number of ids.
FILTER_WORDS = 1 << 22


def pieces(batches) -> Iterator:
    """Arrow batches cut to ARROW_ROWS rows, which bounds what is held as Python objects."""
    for batch in batches:
        for at in range(0, len(batch), ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how far a step that deals rows out should spread them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) of a table of documents, whatever else it holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_and_rest(docs: DataFrame, new: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs as ``doc_id, text`` (null: empty) and its other columns under plain names, and these columns' own names in order.

    Columns named like one of ``new`` are left out, in whatever letter case they come. So no name of
    the table meets a name that an operator uses. ``with_names`` gives the own names back.
    """
    plain, rest, names = [], [], []
    for i, name in enumerate(docs.columns):
        if name in ("doc_id", "text") and name not in plain:
            plain.append(name)
        else:
            plain.append(f"stratalith_{i}")
            if name.lower() not in new:
                rest.append(f"stratalith_{i}")
                names.append(name)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.toDF(*plain).select("doc_id", text, *rest), names


def with_names(out: DataFrame, names: list[str], new: list[str], columns: list[str]) -> DataFrame:
    """The columns of the table that ``text_and_rest`` took apart, in their order and by their names, then the new ones."""
    own = dict(zip(names, (c for c in out.columns if c.startswith("stratalith_")), strict=True)) | {"doc_id": "doc_id", "text": "text"}
    kept = [c for c in columns if c in own]
    return out.select(*(own[c] for c in kept), *new).toDF(*kept, *new)


def _bits(key: Column, words: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(64 * words - 1)) for i in range(2)]


class Filter:
    """Which rows may have a key that is among given ones: a Bloom filter of bounded size.

    It has 16 bits for each of n keys, but never more than FILTER_WORDS words; that bound holds for
    the broadcast and for what the driver sees of it. No row with such a key is missed. Beyond the
    bound more rows pass that have none, up to all of them, which costs time and no result.
    """

    def __init__(self, keys: DataFrame, n: int):
        """keys: one column of longs, repeats allowed."""
        import numpy as np
        import pyarrow as pa

        self.words = min(FILTER_WORDS, 1 << max(0, (16 * n // 64).bit_length()))
        bits = keys.toDF("key").select(F.explode(F.array(*_bits(F.col("key"), self.words))).alias("bit"))
        found = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        table = np.zeros(self.words, dtype=np.int64)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.table = F.broadcast(keys.sparkSession.createDataFrame(pa.table({"stratalith_bits": pa.array([table], pa.list_(pa.int64()))})))

    def _may(self, key: Column) -> Column:
        out = F.lit(True)
        for bit in _bits(key, self.words):
            word = F.get("stratalith_bits", F.shiftright(bit, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return key.isNotNull() & out

    def among(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows whose key may be one. A null key is none."""
        return rows.join(self.table, self._may(key), "left_semi")

    def others(self, rows: DataFrame, key: Column) -> DataFrame:
        """The other rows."""
        return rows.join(self.table, self._may(key), "left_anti")
