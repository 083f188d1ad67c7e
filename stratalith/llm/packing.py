"""Packing: concatenate all token streams and cut them into windows of a fixed length.

Pass one encodes every document once and writes the ids, with each document's offset inside the
task that encoded it. The totals of the tasks, one row a task, are added up to global offsets
(the second pass of a two-pass prefix sum). A document then knows the global position of each of
its ids, so windows are cut without a shuffle: a document that crosses a window's end leaves a
boundary record, a further piece with the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, ship, text_column
from .tokens import encoder, id_bytes, vocabulary_path

SEQUENCE_LENGTH = 2048
END_ID = 1

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, end_id: int, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, task, task_start``: each row's packed ids with the end id appended.

    Ids take two bytes if the vocabulary allows, else four. ``task`` is the partition that encoded the row and ``task_start`` counts the ids of the rows
    that it encoded before.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        path = tokenizer_path or vocabulary_path()
        width = id_bytes(path)
        encode, end = encoder(path, width).encode, end_id.to_bytes(width, "little")
        task, start = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            ids = [encode(x) + end for x in batch.column("text").to_pylist()]
            n = np.fromiter((len(x) // width for x in ids), dtype=np.int64, count=len(ids))
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(ids), task, dtype=np.int64)), pa.array(starts)], ["doc_id", "ids", "n_tokens", "task", "task_start"])

    return text_column(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long, task long, task_start long")


def offsets_of(encoded: DataFrame) -> dict[int, int]:
    """The global offset of each task. One number a task comes to the driver, none for a row."""
    totals = encoded.groupBy("task").agg(F.sum("n_tokens").alias("total")).orderBy("task").collect()
    out, at = {}, 0
    for row in totals:
        out[row["task"]] = at
        at += row["total"]
    return out


def pack(docs: DataFrame, sequence_length: int = SEQUENCE_LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """Pack documents into windows of ``sequence_length`` ids; one row per piece of a document.

    docs needs ``doc_id`` and ``text``; further columns are ignored. A null text is empty, and an
    empty text is its end id alone. Rows with a null or repeated ``doc_id`` are packed as documents
    of their own. An empty table gives no pieces. Long documents fill as many windows as they need.
    Every window but the last is full; the last is what is to be padded. Windows follow the order
    in which the table is read, so no row moves.

    Returns ``doc_id, start, length, ids`` (packed unsigned 32-bit, little-endian), ``ids_crc32,
    doc_tokens, sequence_id, offset``.
    """
    if sequence_length < 1:
        raise ValueError("sequence_length must be positive")
    spark = docs.sparkSession
    ship(spark)
    encoded = Scratch(spark, "pack").keep(encode_documents(docs, end_id, tokenizer_path), "encoded")
    offsets = offsets_of(encoded)

    def cut(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for batch in pieces(batches):
            rows: list[list] = [[] for _ in schema]
            for doc_id, ids, n, task, task_start in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "ids", "n_tokens", "task", "task_start")), strict=True):
                ids = np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4").tobytes()
                position, at = offsets[task] + task_start, 0
                while at < n:
                    sequence, offset = divmod(position + at, sequence_length)
                    length = min(sequence_length - offset, n - at)
                    piece = ids[4 * at : 4 * (at + length)]
                    for column, value in zip(rows, (doc_id, at, length, piece, zlib.crc32(piece), n, sequence, offset), strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return encoded.mapInArrow(cut, PIECES)
