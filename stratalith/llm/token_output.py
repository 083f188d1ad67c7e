"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

An id is replaced by its rank among all ids of the corpus by frequency, so common ids are small
numbers. A rank takes one to four little-endian bytes in a data stream; its length less one takes
two bits in a control stream of its own, four to a byte. A reader looks up the four lengths of each
control byte in a table and gathers the bytes of all numbers, all in numpy.

The format is a folder that any Hadoop file system can hold:

* ``ranks/`` (Parquet): ``rank int, id int, n long`` for every id that occurs, most frequent first,
  ties to the smaller id;
* ``blocks/`` (Parquet, payload not compressed again): ``shard, block, shard_start`` (ids of the
  shard before the block), ``n_docs, n_ids, doc_ids`` (little-endian signed 64-bit), ``null_ids``
  (a bit for each null doc_id), ``lengths`` (ids of each document, in the same code: control, then
  data), ``control, data, crc32`` (of control and data).

Shards and the blocks in them follow ascending doc_id, nulls first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pieces, ship
from .packing import encode_documents
from .tokens import id_bytes, vocabulary_path

END_ID = 2

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16

BLOCKS = "shard int, block int, shard_start long, n_docs int, n_ids long, doc_ids binary, null_ids binary, lengths binary, control binary, data binary, crc32 long"


def vbyte_encode(values) -> tuple[bytes, bytes]:
    """The control and data streams of unsigned 32-bit numbers."""
    import numpy as np

    values = np.ascontiguousarray(values, dtype="<u4")
    extra = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    own = extra[: len(values)]
    bounds = [x for x in (0xFF, 0xFFFF, 0xFFFFFF) if x < values.max(initial=0)]
    for bound in bounds:
        own += values > bound
    ends = np.cumsum(own, dtype=np.int64) + np.arange(1, len(values) + 1)
    data = np.empty(int(ends[-1]) if len(values) else 0, dtype=np.uint8)
    starts = ends - own - 1
    # The j-th byte of all numbers that have one.
    data[starts] = values.astype(np.uint8)
    for j in range(1, len(bounds) + 1):
        longer = np.flatnonzero(own >= j)
        data[starts[longer] + j] = (values[longer] >> np.uint32(8 * j)).astype(np.uint8)
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), data.tobytes()


@cache
def _lengths():
    """The four lengths that each control byte names."""
    import numpy as np

    return ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def vbyte_decode(control: bytes, data: bytes, n: int):
    """The n numbers of two streams, as an array of unsigned 32-bit."""
    import numpy as np

    each = _lengths()[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(each, dtype=np.int64)
    if (int(ends[-1]) if n else 0) != len(data):
        raise ValueError("control and data streams do not fit together")
    starts = ends - each
    padded = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    values = padded[starts].astype("<u4")
    for k in range(1, int(each.max(initial=1))):
        values |= np.where(each > k, padded[starts + k], 0).astype("<u4") << np.uint32(8 * k)
    return values


def _ranks(encoded: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """``rank, id, n``. At most one row for each id of the vocabulary comes to the driver."""

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=f"<u{width}"), minlength=len(total))
            part[: len(total)] += total
            total = part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return [(rank, row["id"], row["n"]) for rank, row in enumerate(sorted(counts, key=lambda r: (-r["n"], r["id"])))]


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer_path: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append ``end_id``, and write the ids to the folder ``path``.

    docs needs ``doc_id`` and ``text``; further columns are ignored. A null or empty text has the
    end id alone. Null doc_ids come first and repeated ones next to each other, each row as a
    document of its own. An empty table gives an empty folder that reads as no documents.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "tokens")
    encoded = scratch.keep(encode_documents(docs, end_id, tokenizer_path), "encoded")
    width = id_bytes(tokenizer_path or vocabulary_path())
    ranks = _ranks(encoded, width)
    spark.createDataFrame(ranks, "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    ids_by_rank = [x[1] for x in ranks]

    def write(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        rank_of = np.zeros(max(ids_by_rank, default=0) + 1, dtype=np.uint32)
        rank_of[ids_by_rank] = np.arange(len(ids_by_rank))
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "null_ids", "lengths", "control", "data")), ("crc32", pa.int64())])
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def finish():
            nonlocal held, size, block, start
            ids = np.frombuffer(b"".join(x[1] for x in held), dtype=f"<u{width}")
            control, data = vbyte_encode(rank_of[ids])
            lengths = b"".join(vbyte_encode(np.array([len(x[1]) // width for x in held])))
            row = (shard, block, start, len(held), len(ids), np.array([x[0] or 0 for x in held], dtype="<i8").tobytes(), np.packbits([x[0] is None for x in held]).tobytes(), lengths, control, data, zlib.crc32(data, zlib.crc32(control)))
            block, start, held, size = block + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in pieces(batches):
            for doc in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append(doc)
                size += len(doc[1]) // width
                if size >= block_ids:
                    yield finish()
        if held:
            yield finish()

    # Rows that share or lack a doc_id spread over tasks by the place where they were encoded.
    keys = ["doc_id", "task", "task_start"]
    ordered = encoded.select("ids", *keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "ids").mapInArrow(write, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("encoded")


def _rows(batch) -> Iterator[dict]:
    """Rows of a batch one at a time, as a block may be large."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written folder; start counts the ids of all documents before.

    ids are packed unsigned 32-bit, little-endian. A damaged block raises.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ids_by_rank = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    offsets, at = {}, 0
    for row in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        offsets[row["shard"]] = at
        at += row["n"]

    def read(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        id_of = np.array(ids_by_rank, dtype="<u4")
        for batch in batches:
            for row in _rows(batch):
                if zlib.crc32(row["data"], zlib.crc32(row["control"])) != row["crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']} is damaged")
                n = row["n_docs"]
                ids = id_of[vbyte_decode(row["control"], row["data"], row["n_ids"])]
                quads = -(-n // 4)
                lengths = vbyte_decode(row["lengths"][:quads], row["lengths"][quads:], n).astype(np.int64)
                ends = np.cumsum(lengths)
                packed = ids.tobytes()
                null = np.unpackbits(np.frombuffer(row["null_ids"], dtype=np.uint8), count=n).astype(bool)
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=null)
                texts = pa.array([packed[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(offsets[row["shard"]] + row["shard_start"] + ends - lengths), pa.array(lengths), texts], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
