"""Exact dedup by an exchange of Golomb-coded fingerprints.

Texts are equal if they are identical once white space is deleted. Blocks of rows sort short
fingerprints of their texts and send them, as Golomb-Rice-coded gaps, to the owners of fingerprint
ranges. An owner answers each block with a bitmap of the fingerprints that another block has too.
Only rows marked in this way are suspects. A filter of bounded size picks their texts where they
lie; these alone are shuffled and grouped by their bytes, after a partial aggregate on the map side,
which settles what the short fingerprints left open.

Blocks grow with the table so that there are never more than ``BLOCKS_MOST`` of them: the number of
messages, blocks times owners, then grows in proportion to the rows, and each holds many gaps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Filter, Scratch, pieces, ship, text_column

#: Rows of a block at least, blocks at most, and fingerprints that an owner takes on average at most.
BLOCK_ROWS = 1 << 16
BLOCKS_MOST = 1 << 13
OWNER_FINGERPRINTS = 1 << 19

#: Bits of a fingerprint above the logarithm of the number of rows: one text in 256 is a suspect by chance.
SPARE_BITS = 8


def rice_encode(gaps, k: int) -> tuple[bytes, bytes]:
    """Unary quotients (ones, then a zero) and k-bit remainders, as two bit streams."""
    import numpy as np

    gaps = np.asarray(gaps, dtype=np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[::-1] & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low.reshape(-1)).tobytes()


def rice_decode(unary: bytes, low: bytes, k: int, n: int):
    import numpy as np

    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)) == 0)[:n]
    quotients = (np.diff(zeros, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(low, dtype=np.uint8), count=n * k).reshape(n, k)
    remainders = np.zeros(n, dtype=np.uint64)
    for column in range(k):
        remainders = remainders << np.uint64(1) | bits[:, column]
    return quotients << np.uint64(k) | remainders


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(None, ASCII_SPACE)


BLOCKS = "src string, n int, doc_ids binary, null_ids binary, lengths binary, digests binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """A task's blocks of up to BLOCK_ROWS rows: ids, code points and SHA-256 of the normalised texts."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, block = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        digests: list[bytes] = []

        def finish():
            nonlocal block, ids, lengths, digests
            row = [f"{task}-{block}", len(ids), np.array([x or 0 for x in ids], dtype="<i8").tobytes(), np.packbits([x is None for x in ids]).tobytes(), np.array(lengths, dtype="<i8").tobytes(), b"".join(digests)]
            block, ids, lengths, digests = block + 1, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["src", "n", "doc_ids", "null_ids", "lengths", "digests"])

        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            ids += batch.column("doc_id").to_pylist()
            lengths += map(len, texts)
            digests += [hashlib.sha256(normalised(x)).digest() for x in texts]
            if len(ids) >= BLOCK_ROWS:
                yield finish()
        if ids:
            yield finish()

    return docs.mapInArrow(run, BLOCKS)


def _joined(blocks: DataFrame, rows: int) -> DataFrame:
    """The tasks' blocks put together to blocks of a size that the number of rows asks for. Texts do not move, some 40 bytes a row do."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        held: list[dict] = [row for batch in batches for row in batch.to_pylist()]
        if held:
            null = np.concatenate([np.unpackbits(np.frombuffer(x["null_ids"], dtype=np.uint8), count=x["n"]) for x in held])
            row = [str(TaskContext.get().partitionId()), len(null), b"".join(x["doc_ids"] for x in held), np.packbits(null).tobytes(), *(b"".join(x[k] for x in held) for k in ("lengths", "digests"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["src", "n", "doc_ids", "null_ids", "lengths", "digests"])

    size = max(BLOCK_ROWS, -(-rows // BLOCKS_MOST))
    return blocks.repartition(max(1, -(-rows // size)), "src").mapInArrow(run, BLOCKS)


def _fingerprints(digests: bytes, width: int):
    import numpy as np

    return np.frombuffer(digests, dtype=">u8")[::4].astype(np.uint64) >> np.uint64(64 - width)


def _send(blocks: DataFrame, width: int, owner_bits: int) -> DataFrame:
    """Each block's distinct fingerprints, sorted and coded, to their owners."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for src, digests in zip(batch.column("src").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                own = np.unique(_fingerprints(digests, width))
                owners = (own >> np.uint64(width - owner_bits)).astype(np.int64)
                for part in np.split(own, np.flatnonzero(np.diff(owners)) + 1):
                    gaps = np.diff(part, prepend=part[:1] & ~np.uint64((1 << (width - owner_bits)) - 1))
                    k = max(0, int(math.log2(max(1.0, 0.69 * float(gaps.mean())))))
                    for column, value in zip(rows, (int(part[0] >> np.uint64(width - owner_bits)), src, len(part), k, *rice_encode(gaps, k)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["owner", "src", "n", "k", "unary", "low"])

    return blocks.select("src", "digests").mapInArrow(run, "owner long, src string, n int, k int, unary binary, low binary")


def _answer(messages: DataFrame) -> DataFrame:
    """Each owner's bitmaps: which of a block's fingerprints another block has sent too.

    An owner holds its range alone, OWNER_FINGERPRINTS on average; fingerprints are hashes and each
    block sends one once, so the copies of one text add one entry a block.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        lists = [np.cumsum(rice_decode(r["unary"], r["low"], r["k"], r["n"]), dtype=np.uint64) for r in table.to_pylist()]
        both, count = np.unique(np.concatenate(lists), return_counts=True)
        both = both[count > 1]
        maps = [np.packbits(np.isin(x, both, assume_unique=True)).tobytes() for x in lists]
        return pa.table({"owner": table.column("owner"), "src": table.column("src"), "n": table.column("n"), "bitmap": pa.array(maps, pa.binary())})

    return messages.groupBy("owner").applyInArrow(run, "owner long, src string, n int, bitmap binary")


def _marked(blocks: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_chars, digest, row, suspect`` of every row."""
    by_block = answers.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("owner", "n", "bitmap"))).alias("answers"))

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                prints = _fingerprints(row["digests"], width)
                own, back, count = np.unique(prints, return_inverse=True, return_counts=True)
                bits = np.concatenate([np.unpackbits(np.frombuffer(x["bitmap"], dtype=np.uint8), count=x["n"]) for x in row["answers"]]).astype(bool)
                suspect = (bits | (count > 1))[back]
                null = np.unpackbits(np.frombuffer(row["null_ids"], dtype=np.uint8), count=row["n"]).astype(bool)
                digests = row["digests"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=null),
                        pa.array(np.frombuffer(row["lengths"], dtype="<i8")),
                        pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()),
                        pa.array([f"{row['src']}-{i}" for i in range(row["n"])]),
                        pa.array(suspect),
                    ],
                    ["doc_id", "n_chars", "digest", "row", "suspect"],
                )

    return blocks.join(by_block, "src").mapInArrow(run, "doc_id long, n_chars long, digest binary, row string, suspect boolean")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: ``doc_id, keep_id, group_size, kept, text_sha256``.

    docs needs ``doc_id`` and ``text``; further columns are ignored. A null text is empty, and empty
    or blank texts are equal to each other. Of equal texts the row with the most code points in its
    original text stays, then that with the smallest doc_id; a null doc_id comes after all others.
    Rows that repeat a doc_id and a text count one by one, and one of them is kept. ``keep_id`` is
    the doc_id of the row that stays, ``group_size`` the number of rows with the text. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "exact")
    docs = text_column(docs)
    parts = scratch.keep(_blocks(docs), "parts")
    rows = parts.agg(F.sum("n")).first()[0] or 0
    blocks = scratch.keep(_joined(parts, rows), "blocks")
    owner_bits = max(0, math.ceil(math.log2(max(1, rows / OWNER_FINGERPRINTS))))
    width = min(63, max(owner_bits + 1, math.ceil(math.log2(max(2, rows))) + SPARE_BITS))
    marked = scratch.keep(_marked(blocks, _answer(_send(blocks, width, owner_bits)), width), "marked", rows=rows)
    scratch.drop("parts", "blocks")

    suspects = marked.where("suspect")
    rank = F.struct(F.col("n_chars").alias("a"), F.col("doc_id").isNotNull().alias("b"), (-F.coalesce("doc_id", F.lit(0))).alias("c"), F.col("row").alias("d"))
    classes = suspects.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(rank).alias("best"))
    # Byte verification: of all texts grouped by their bytes, those of a suspect among them, a digest must have one.
    name = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = Filter(suspects.select(name), suspects.count())
    squeezed = F.col("text")
    for code in ASCII_SPACE:
        squeezed = F.replace(squeezed, F.lit(chr(code)), F.lit(""))
    texts = found.among(docs, name).groupBy(squeezed.alias("squeezed")).agg(F.count("*").alias("n"))
    verified = texts.groupBy(F.unhex(F.sha2("squeezed", 256)).alias("digest")).agg(F.count("*").alias("n_texts"))
    classes = classes.join(verified, "digest", "left").select(
        "digest",
        "group_size",
        F.when(F.coalesce("n_texts", F.lit(1)) > 1, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.when(F.col("best.b"), -F.col("best.c"))).cast("long").alias("keep_id"),
        F.col("best.d").alias("best_row"),
    )
    classes = scratch.keep(classes, "classes", rows=rows)
    out = marked.join(classes, "digest", "left")
    return out.select(
        "doc_id",
        F.when(F.col("best_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
