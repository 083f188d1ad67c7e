"""Exact top-k search by inner product over vector-approximation files.

Vectors of whole numbers are written in blocks. A block's approximation is one byte a component that
names a cell, an interval between the component's least and greatest value in the block; the exact
vectors are a column of their own, which a scan of the approximations does not read. Two matrix
products over the cells bound every inner product of a query from above and below.

1. Query blocks scan the approximations of all data blocks. Each task keeps the k best lower bounds of
   each query; these are merged, 32 parts at a time, to a score that the query's k-th is certain to reach.
2. A second scan marks the vectors whose upper bound reaches that score for some query of a block.
3. The marked vectors alone are read from the exact column and go to the query blocks that need them.
   A query takes them in the order of their upper bounds until its k-th score is above all bounds that
   are left.

Both scans are a two-dimensional grid of parts of the queries and parts of the data, whose numbers
follow from counts of blocks. What a task emits is one record for a pair of blocks, or k rows a
query, however many vectors tie. A ranked window merges the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

BLOCK_ROWS = 2048
QUERY_ROWS = 4096
#: Data blocks and query blocks that one task of the grid reads on average.
GROUP_BLOCKS = 32
GROUP_QUERIES = 4
#: Parts whose lower bounds are merged at a time.
MERGED = 32
#: Cells of a component.
CELLS = 64
#: Exact vectors that are read at a time.
READ_ROWS = 32
SCALE = 64

#: low, high and width are of the cells of each component, codes the cells of each vector, exact the vectors.
BLOCKS = "block string, dim int, n int, ids binary, low binary, high binary, width binary, codes binary, exact binary"
APPROXIMATION = ["block", "dim", "n", "ids", "low", "high", "width", "codes"]


def integer_rows(batch, id_column: str, vector_column: str, scale: int) -> Iterator[tuple]:
    """``ids, matrix`` for each vector length of an Arrow batch: floor(scale * x) of the usable rows, whole numbers as doubles."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, lists = batch.column(id_column), batch.column(vector_column)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    names = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero((lengths == length) & valid)
        matrix = values[starts[rows, None] + np.arange(length)]
        finite = np.isfinite(matrix * scale).all(axis=1)
        if not np.isfinite(matrix).all(axis=1)[~finite].sum() == 0:
            raise OverflowError("a component is too large to be scaled")
        yield names[rows[finite]], np.floor(matrix[finite] * scale)


def vector_blocks(rows: DataFrame, block_rows: int, scale: int) -> DataFrame:
    """Blocks of ``vec_id, embedding`` rows by length of the vector."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        names = [x.split()[0] for x in BLOCKS.split(", ")]

        def finish(dim: int, ids, matrix):
            nonlocal count
            count += 1
            cells = Cells.of(matrix)
            row = (f"{task}-{count}", dim, len(ids), ids.astype("<i8").tobytes(), *(x.tobytes() for x in (cells.low, cells.high, cells.width, cells.codes)), matrix.astype("<f8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 6), strict=True)], names)

        for batch in batches:
            for ids, matrix in integer_rows(batch, "vec_id", "embedding", scale):
                dim = matrix.shape[1]
                if dim in held:
                    ids, matrix = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], matrix])
                while len(ids) >= block_rows:
                    yield finish(dim, ids[:block_rows], matrix[:block_rows])
                    ids, matrix = ids[block_rows:], matrix[block_rows:]
                held[dim] = [ids, matrix]
        for dim, (ids, matrix) in held.items():
            if len(ids):
                yield finish(dim, ids, matrix)

    return rows.mapInArrow(run, BLOCKS)


class Cells:
    """The approximation of a block: cells of each component, and the bounds that they give."""

    def __init__(self, low, high, width, codes):
        self.low, self.high, self.width, self.codes = low, high, width, codes

    @classmethod
    def of(cls, matrix) -> Cells:
        import numpy as np

        low, high = matrix.min(axis=0), matrix.max(axis=0)
        width = np.maximum(1.0, np.ceil(high / CELLS - low / CELLS + 1 / CELLS))
        return cls(low, high, width, np.clip((matrix - low) // width, 0, CELLS - 1).astype(np.uint8))

    @classmethod
    def read(cls, row) -> Cells:
        import numpy as np

        low, high, width = (np.frombuffer(row[k], dtype="<f8") for k in ("low", "high", "width"))
        return cls(low, high, width, np.frombuffer(row["codes"], dtype=np.uint8).reshape(row["n"], row["dim"]))

    def bounds(self, queries):
        """Twice the upper and lower bounds of every inner product, queries by rows.

        Where sums may leave the whole numbers that a double holds, a margin for rounding is added.
        """
        import numpy as np

        size = np.maximum(np.abs(self.low), np.abs(self.high)).max(initial=0)
        reach = 4 * float(np.abs(queries).max(initial=0)) * float(size) * queries.shape[1]
        floor = self.low + self.codes * self.width
        ceiling = np.minimum(floor + self.width - (reach < 2**53), self.high)
        kind = np.float32 if reach < 2**24 else np.float64  # either holds these whole numbers exactly
        middle = queries.astype(kind) @ (floor / 2 + ceiling / 2 if reach >= 2**53 else floor + ceiling).T.astype(kind)
        spread = np.abs(queries).astype(kind) @ np.maximum(ceiling - floor, 0).T.astype(kind)
        if reach >= 2**53:
            # Rounding of the products, and of the cells' limits themselves.
            middle, slack = 2 * middle, reach * 2.0**-44
            return middle + spread + slack, middle - spread - slack
        return middle + spread, middle - spread


def scores_of(rows, query):
    """Inner products of whole numbers: doubles or 64-bit integers as long as these are exact, else integers without limit."""
    import numpy as np

    reach = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if reach < 2**53:
        return (rows @ query).astype(np.int64)
    if reach < 2**62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    exact = [int(x) for x in query.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, exact, strict=True)) for row in rows.tolist()], dtype=object)


def without_own(upper, lower, query_ids, ids):
    """Bounds of which a query's own id has none."""
    import numpy as np

    own = query_ids[:, None] == ids[None, :]
    upper[own] = lower[own] = -np.inf
    return upper, lower


def best_of(bounds, k: int):
    """The k greatest of each row, filled up with minus infinity."""
    import numpy as np

    missing = np.full((len(bounds), max(0, k - bounds.shape[1])), -np.inf)
    bounds = np.concatenate([bounds, missing], axis=1)
    return np.partition(bounds, bounds.shape[1] - k, axis=1)[:, bounds.shape[1] - k :]


class Search:
    """The best k of each query so far, from exact vectors that are taken in the order of their bounds."""

    def __init__(self, query_ids, queries, k: int, certain):
        """certain: twice a score that each query's k-th is certain to reach."""
        self.query_ids, self.queries, self.k, self.certain = query_ids, queries, k, certain
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
        self.read = 0

    def take(self, ids, cells: Cells, matrix) -> None:
        import numpy as np

        upper, _ = without_own(*cells.bounds(self.queries), self.query_ids, ids)
        for i in np.flatnonzero((upper >= self.certain[:, None]).any(axis=1)).tolist():
            bound = upper[i]
            order = np.flatnonzero((bound >= self.certain[i]) & (bound > -np.inf))
            order = order[np.argsort(-bound[order], kind="stable")]
            for at in range(0, len(order), READ_ROWS):
                if bound[order[at]] < self.certain[i]:
                    break  # no bound that is left reaches the k-th score
                part = order[at : at + READ_ROWS]
                self.read += len(part)
                scores = scores_of(matrix[part], self.queries[i]).tolist()
                self.best[i] = sorted([*self.best[i], *((-s, x) for s, x in zip(scores, ids[part].tolist(), strict=True))])[: self.k]
                if len(self.best[i]) == self.k:
                    least = -2.0 * self.best[i][-1][0]
                    self.certain[i] = max(self.certain[i], least - (abs(least) * 2.0**-50 if abs(least) >= 2**53 else 0))


def _queries(row):
    import numpy as np

    return np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["exact"], dtype="<f8").reshape(row["n"], row["dim"])


def _grid(left: DataFrame, right: DataFrame, keys: tuple[str, str], work, schema: str) -> DataFrame:
    """``work(query_table, data_table)`` for each pair of parts."""
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows by inner product for each row that is a query.

    vectors needs ``vec_id`` and ``embedding``; further columns are ignored. ``queries`` is a condition
    on these rows. Components become floor(scale * x) and scores are exact whole numbers, whatever the
    size of the components; a score among the results that no long holds raises, as does a component
    that no double holds once scaled. Ties go to the smaller vec_id. Vectors that are null, empty, or
    hold a null or a number that is not finite take no part, nor do rows with a null vec_id. Vectors
    meet those of their own length only. A query's own vec_id is no candidate; other rows that repeat a
    vec_id count one by one. A query without candidates gives no row, nor does an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "topk")
    wanted = scratch.keep(vectors.where(queries).select("vec_id", "embedding"), "asked")
    blocks = scratch.keep(vector_blocks(vectors.select("vec_id", "embedding"), BLOCK_ROWS, scale), "blocks")
    wanted = wanted.repartition(max(1, -(-wanted.count() // QUERY_ROWS)))
    asked = scratch.keep(vector_blocks(wanted, QUERY_ROWS, scale).select(F.col("block").alias("query_block"), "dim", "n", "ids", "exact"), "queries")
    scratch.drop("asked")

    n_queries, n_blocks = asked.count(), blocks.count()
    q_parts = max(1, -(-n_queries // GROUP_QUERIES))
    parts = max(1, min(n_blocks, max(-(-2 * spark.sparkContext.defaultParallelism // q_parts), -(-n_blocks // GROUP_BLOCKS))))
    part_of = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ("q_part", "part")
    asked = asked.withColumn("q_part", part_of("query_block", q_parts))
    scanned = blocks.select(*APPROXIMATION).withColumn("part", part_of("block", parts)).withColumn("q_part", every(q_parts))

    def floors(query_table, data_table):
        """The k best lower bounds of each query in a part."""
        import numpy as np
        import pyarrow as pa

        data = [(np.frombuffer(r["ids"], dtype="<i8"), Cells.read(r)) for r in data_table.to_pylist()]
        out = []
        for row in query_table.to_pylist():
            ids, matrix = _queries(row)
            best = np.full((len(ids), k), -np.inf)
            for names, cells in data:
                if len(cells.low) == row["dim"]:
                    _, lower = without_own(*cells.bounds(matrix), ids, names)
                    best = best_of(np.concatenate([best, lower.astype(np.float64)], axis=1), k)
            out.append((row["query_block"], row["part"], best.tobytes()))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["query_block", "part", "floors"])

    def merge(table):
        import numpy as np
        import pyarrow as pa

        best = best_of(np.concatenate([np.frombuffer(x, dtype="<f8").reshape(-1, k) for x in table.column("floors").to_pylist()], axis=1), k)
        return pa.table([table.column("query_block")[:1], pa.array([table.column("part")[0].as_py() // MERGED], pa.int32()), pa.array([best.tobytes()], pa.binary())], names=["query_block", "part", "floors"])

    shape = "query_block string, part int, floors binary"
    least, left = _grid(asked.withColumn("part", every(parts)), scanned, keys, floors, shape), parts
    while left > 1:
        least, left = least.groupBy("query_block", F.floor(F.col("part") / MERGED)).applyInArrow(merge, shape), -(-left // MERGED)
    least = scratch.keep(least.select("query_block", "floors"), "floors")
    asked = scratch.keep(asked.join(least, "query_block"), "certain")

    def mark(query_table, data_table):
        """One record for each query block and data block: which vectors some query must read."""
        import numpy as np
        import pyarrow as pa

        data = [(r["block"], np.frombuffer(r["ids"], dtype="<i8"), Cells.read(r)) for r in data_table.to_pylist()]
        out = []
        for row in query_table.to_pylist():
            ids, matrix = _queries(row)
            certain = np.frombuffer(row["floors"], dtype="<f8").reshape(-1, k).min(axis=1)
            for block, names, cells in data:
                if len(cells.low) == row["dim"]:
                    upper, _ = without_own(*cells.bounds(matrix), ids, names)
                    needed = ((upper >= certain[:, None]) & (upper > -np.inf)).any(axis=0)
                    if needed.any():
                        out.append((row["query_block"], block, np.packbits(needed).tobytes()))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["query_block", "block", "needed"])

    marks = scratch.keep(_grid(asked.withColumn("part", every(parts)), scanned, keys, mark, "query_block string, block string, needed binary"), "marks")
    kinds = "query_block string, " + BLOCKS

    def read(batches) -> Iterator:
        """The marked vectors of a block, with their cells."""
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in kinds.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["needed"], dtype=np.uint8), count=row["n"]))
                cut = {"n": len(at), "ids": np.frombuffer(row["ids"], dtype="<i8")[at].tobytes()}
                for name, dtype in (("codes", np.uint8), ("exact", "<f8")):
                    cut[name] = np.frombuffer(row[name], dtype=dtype).reshape(row["n"], row["dim"])[at].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([(row | cut)[x]], t) for x, t in zip(names, types, strict=True)], names)

    needed = marks.join(blocks.hint("merge"), "block").mapInArrow(read, kinds).withColumn("part", part_of("block", parts))

    def search(query_table, data_table):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[] for _ in range(4)]
        data = [(Cells.read(r), *_queries(r)) for r in data_table.to_pylist()]
        for row in query_table.to_pylist():
            found = Search(*_queries(row), k, np.frombuffer(row["floors"], dtype="<f8").reshape(-1, k).min(axis=1).copy())
            for cells, names, matrix in data:
                found.take(names, cells, matrix)
            for i, best in enumerate(found.best):
                out[0] += [int(found.query_ids[i])] * len(best)
                out[1] += [f"{row['query_block']}-{i}"] * len(best)
                out[2] += [x for _, x in best]
                out[3] += [-s for s, _ in best]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "query_row", "vec_id", "score"])

    best = _grid(asked.withColumn("part", every(parts)), needed, ("query_block", "part"), search, "query_id long, query_row string, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
