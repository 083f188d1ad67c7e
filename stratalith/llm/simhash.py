"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most three
bits, some segment starts a chain in which every run of l segments has at most 3 * l / 4 differing
bits: none in the first segment, one in the first two, two in the first three. So a linked pair is
equal in a whole segment and, as the next segment differs in one bit at most, in one half of that:
24 equal bits name the bucket in which the pair meets. Inside a bucket the chain's budgets prune
candidates before the full count.

Equal fingerprints are one vertex. A bucket gives a spanning forest of its links, never its pairs,
and a bucket over ``BUCKET`` fingerprints is cut into chunks that meet two at a time in tasks of
their own, so that no task holds a large bucket whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components
from .common import Filter, Scratch, pieces, ship, text_column

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS = 4
BUCKET = 2048


def fingerprint_of(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, unsigned.

    A-Z is lower-cased, words are runs free of ``[\\x20\\x09-\\x0D]``, shingles are joined by one
    space and count with repeats. Fewer words than a shingle has make one shingle; no word makes
    the fingerprint zero. A bit is set if more than half of the shingles' hashes have it.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: fp is the fingerprint as a signed long."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches):
            prints = np.array([fingerprint_of(x, shingle_words) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _keys() -> Column:
    """The eight bucket names of a fingerprint: start segment, half, 16 bits, 8 bits."""
    fp, keys = F.col("fp"), []
    for i in range(SEGMENTS):
        following = _segment(fp, (i + 1) % SEGMENTS)
        for half in (0, 1):
            eight = F.shiftright(following, 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append(F.lit((2 * i + half) << 24) + F.shiftleft(_segment(fp, i), 8) + eight)
    return F.explode(F.array(*keys))


def _linked(fp, others, start):
    """Which of others link with fp, for pairs whose chain starts at a segment: budgets first, then all bits."""
    import numpy as np

    differing = np.bitwise_xor(fp, others)
    # The ring is turned so that the chain starts at the lowest segment.
    turn = (16 * start).astype(np.uint64) if hasattr(start, "astype") else np.uint64(16 * start)
    back = (np.uint64(64) - turn) & np.uint64(63)
    turned = np.where(turn == 0, differing, differing >> turn | differing << back)
    ok = np.ones(len(turned), dtype=bool)
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (16 * length)) - 1)
        live = np.flatnonzero(ok)
        ok[live] = np.bitwise_count(turned[live] & mask) <= MAX_BITS * length // SEGMENTS
    return ok


def _forest(fps, start: int) -> tuple[list, list]:
    """A spanning forest of the links among the distinct fingerprints of one bucket."""
    import numpy as np

    us, vs, left = [], [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            fp = queue.pop()
            hit = _linked(fp, left, start)
            if hit.any():
                found = left[hit]
                us.append(np.full(len(found), fp))
                vs.append(found)
                queue += list(found)
                left = left[~hit]
    return us, vs


def _edges(groups: DataFrame) -> DataFrame:
    """``u, v`` of rows ``bucket, a, b, fp`` that come with equal (bucket, a, b) together."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def work(names, fps):
            """Whole groups: names is an array of rows (bucket, a, b)."""
            us, vs = [], []
            new = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(fps)]]))
            # Small groups all at once: each row against the row d places on.
            small = sizes <= 8
            size_at, start_at = np.repeat(np.where(small, sizes, 0), sizes), np.repeat(starts, sizes)
            place = np.arange(len(fps)) - start_at
            for d in range(1, 8):
                here = np.flatnonzero(place + d < size_at)
                if not len(here):
                    break
                hit = _linked(fps[here], fps[here + d], names[here, 0] >> 25)
                us.append(fps[here[hit]])
                vs.append(fps[here[hit] + d])
            for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
                more = _forest(np.unique(fps[s : s + n]), int(names[s, 0]) >> 25)
                us += more[0]
                vs += more[1]
            if not us:
                return None
            u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        names, fps = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            more = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("bucket", "a", "b")], axis=1)
            names = np.concatenate([names, more])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(fps) < 65_536 and len(more):
                continue
            # The last group may go on in the next batch; a group is two chunks at most.
            open_from = len(names) - int(np.argmin((names[::-1] == names[-1]).all(axis=1))) if (names != names[-1]).any() else 0
            if open_from:
                if (out := work(names[:open_from], fps[:open_from])) is not None:
                    yield out
                names, fps = names[open_from:], fps[open_from:]
        if len(fps) and (out := work(names, fps)) is not None:
            yield out

    return groups.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: linked rows share the smallest doc_id reachable.

    docs needs ``doc_id`` and ``text``; further columns are ignored. A null or blank text has the
    fingerprint zero, which links like any other. Rows that repeat a doc_id count one by one. A
    null doc_id names no component: it takes its group's smallest doc_id, or null if none has one.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(fingerprints(text_column(docs), shingle_words), "prints")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes", rows=prints.count())
    n = nodes.count()

    keys = nodes.select(_keys().alias("bucket"), "fp")
    large = scratch.keep(keys.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "large", rows=8 * n // bucket)
    if large.isEmpty():
        groups = keys.withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    else:
        chunks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(bucket)).cast("int")
        groups = keys.join(large, "bucket", "left").withColumn("chunks", chunks).withColumn("own", F.pmod(F.hash("fp"), F.col("chunks")))
        groups = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        groups = groups.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = groups.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    roots = star_components(_edges(dealt), scratch, rows=8 * n)

    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.keep(rooted, "rooted", rows=n)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.keep(rooted.join(least, "root").select("fp", "component_id"), "named", rows=n)
    scratch.drop("nodes", "large", "rooted")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay when one document of each group does: its smallest doc_id.

    Of rows that repeat the staying doc_id all stay, as do rows with a null doc_id.
    """
    found = near_duplicates(docs)
    stays = F.bool_or(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    gone = found.groupBy("doc_id").agg(stays.alias("stays")).where(~F.col("stays")).select(F.col("doc_id").alias("__stratalith_gone"))
    gone = Scratch(docs.sparkSession, "simhash").keep(gone, "gone", rows=docs.count())
    # Texts of which none can go stay where they are, as far as a filter of bounded size can tell.
    key, may = F.col("doc_id").cast("long"), Filter(gone, gone.count())
    moved = may.among(docs, key).join(gone.hint("merge"), key == F.col("__stratalith_gone"), "left_anti")
    return moved.unionByName(may.others(docs, key))
