"""Suffix-array dedup: repeated passages by a sparse suffix array.

Of all suffixes of the texts' words only those are kept that start at a minimiser: a position whose
hash of the next ``GRAM`` words is the least in some window of ``WINDOW`` positions. Windows look at
content alone, so each copy of a passage keeps the same suffixes, and a passage of ``MIN_WORDS``
words has one that starts among its first ``WINDOW`` words and so has ``HEAD`` words of the passage
before it ends. A suffix whose head, its first ``HEAD`` words, is that of no other one has no
neighbour to share anything with, and goes.

The others are sorted by head, document and position, and neighbours are compared: each extends its
match to the right and to the left, word by word, with the suffix before it and with the first of its
run, the earliest occurrence of the head. For this it carries a 32-bit hash of each of ``SIDE`` words
on either side. Matches of ``MIN_WORDS`` words or more are marked in the later text; the matches of
all suffixes of a passage overlap and together cover it, however long it is.

A suffix that shares its head with others may match another one where it matches neither of these
two. Of the windows of ``MIN_WORDS`` words around the head those that no match holds are left open. For
the runs of such suffixes these windows are hashed, and an aggregate finds the first place of each.

Hashes only propose matches. For each proposed range the words at both places are compared, by a
128-bit hash of their bytes; a range whose words differ somewhere is read at both places and keeps
the stretches of MIN_WORDS equal words that it has. So no word is cut that does not stand elsewhere.
A 32-bit hash that two words share can hide a repeat, once in some 10**9 comparisons.

The sort is by range and includes document and position, so a passage that a third of the documents
share is spread over many tasks; what a task must know of the rows before its first is one record a
task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_SPACE, Filter, Scratch, parallelism, pieces, ship, text_and_rest, with_names

_FIELDS = "text string, n_words bigint, n_dropped bigint, passages array<struct<begin: bigint, end: bigint>>, sources array<bigint>"

MIN_WORDS = 50
WINDOW = 35
GRAM = 6
#: Words that every kept suffix of a passage of MIN_WORDS has before the passage ends, at least for the first.
HEAD = MIN_WORDS - WINDOW + 1
#: Words that are carried on each side: a match of MIN_WORDS that holds the head has no more on either side.
SIDE = MIN_WORDS - HEAD


#: Bits of the hashes by which words beside heads are compared.
HASH_BITS = 32

#: Documents of a file of tables that have a row, or rows, for each.
DOC_ROWS = 4096


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x):
    """Scatter 64-bit values, so that low and high bits are fit to compare and to cut."""
    import numpy as np

    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


#: Odd bases and their inverses modulo 2**64, for hashes of byte runs and of word runs.
_BYTE_BASE, _WORD_BASE = 0x5851F42D4C957F2D, 0x14057B7EF767814F


class _Runs:
    """Hashes of runs of a sequence of 64-bit values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values, base: int):
        import numpy as np

        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)])
        self.back = _powers(pow(base, -1, 1 << 64), len(values) + 1)

    def __call__(self, starts, ends):
        return _mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def word_spans(data: bytes):
    """Starts and ends of the words, runs free of ``[\\x20\\x09-\\x0D]``, in UTF-8 bytes."""
    import numpy as np

    space = np.zeros(256, dtype=bool)
    space[list(ASCII_SPACE)] = True
    word = np.concatenate([[False], ~space[np.frombuffer(data, dtype=np.uint8)], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


class Words:
    """The words of texts as hashes, and the suffixes that are kept. Words are numbered through all texts.

    ``of`` is the text of each word, ``first`` and ``last`` where each text begins and ends. No hash looks
    beyond its own words, and no window beyond its text, so it makes no difference which texts come together.
    """

    def __init__(self, *texts: bytes):
        import numpy as np

        data = b"\n".join(texts)
        self.starts, self.ends = word_spans(data)
        self.of = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), self.starts, side="right")
        self.last = np.cumsum(np.bincount(self.of, minlength=len(texts)))
        self.first = np.concatenate([[0], self.last[:-1]])
        table = _mix(np.arange(1, 257, dtype=np.uint64))
        self.hashes = _Runs(table[np.frombuffer(data, dtype=np.uint8)], _BYTE_BASE)(self.starts, self.ends)
        self.runs = _Runs(self.hashes, _WORD_BASE)

    def kept(self):
        """The minimisers that have a whole head, of texts of MIN_WORDS words or more."""
        import numpy as np

        n = len(self.of)
        if n < MIN_WORDS:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(n - GRAM + 1)
        windows = np.lib.stride_tricks.sliding_window_view(self.runs(at, at + GRAM), WINDOW)
        begin = np.arange(len(windows))
        # A window lies in one text if its last word is of the first one's.
        whole = np.flatnonzero((begin + WINDOW + GRAM - 1 <= self.last[self.of[begin]]) & (self.last - self.first >= MIN_WORDS)[self.of[begin]])
        kept = np.unique(windows[whole].argmin(axis=1) + whole)
        return kept[kept + HEAD <= self.last[self.of[kept]]]

    def heads(self, positions):
        import numpy as np

        return self.runs(positions, positions + HEAD).view(np.int64)

    def contexts(self, positions, bits: int):
        """For each position 2 * SIDE hashes of at most 32 bits: of the words after the head, and of those before it, nearest first.

        Past an end of the text stands 0, which is no word's hash.
        """
        import numpy as np

        small = np.zeros(len(self.of) + SIDE * (len(self.last) + 1), dtype="<u4")
        small[np.arange(len(self.of)) + SIDE * (self.of + 1)] = np.maximum((self.hashes >> np.uint64(64 - bits)).astype(np.uint32), np.uint32(1))
        steps, at = np.arange(SIDE), (positions + SIDE * (self.of[positions] + 1))[:, None]
        return np.concatenate([small[at + HEAD + steps], small[at - 1 - steps]], axis=1)


#: Bytes of texts that are hashed at once, save that a longer text is hashed by itself.
GROUP_BYTES = 1 << 20


def _together(batches, *columns: str) -> Iterator[tuple]:
    """``Words`` of texts that are hashed at once, and the entries of other columns for them."""
    for batch in pieces(batches):
        texts = [x.encode("utf-8", "replace") for x in batch.column("text").to_pylist()]
        others = [batch.column(k).to_pylist() for k in columns]
        size, begin = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > GROUP_BYTES:
                yield Words(*texts[begin:i]), *(x[begin:i] for x in others)
                size, begin = 0, i
            size += len(text) + 1
        if texts:
            yield Words(*texts[begin:]), *(x[begin:] for x in others)


def suffix_heads(docs: DataFrame) -> DataFrame:
    """``head, doc_id, pos`` of the kept suffixes."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for words, ids in _together(batches, "doc_id"):
            kept = words.kept()
            of = words.of[kept]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words.heads(kept), np.array(ids, dtype=np.int64)[of], (kept - words.first[of]).astype(np.int32))], ["head", "doc_id", "pos"])

    return docs.mapInArrow(run, "head long, doc_id long, pos int")


def _with_contexts(docs: DataFrame, bits: int) -> DataFrame:
    """``head, doc_id, pos, context`` of texts that come with the ``pos`` of their suffixes of common head."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for words, ids, positions in _together(batches, "doc_id", "pos"):
            wanted = [np.array(pos, dtype=np.int64) for pos in positions]
            wanted = np.concatenate([pos[pos < last - first] + first for pos, first, last in zip(wanted, words.first, words.last, strict=True)])
            at = np.intersect1d(wanted, words.kept())
            of, contexts = words.of[at], words.contexts(at, bits)
            found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * SIDE), len(at), [None, pa.py_buffer(contexts.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(words.heads(at)), pa.array(np.array(ids, dtype=np.int64)[of]), pa.array((at - words.first[of]).astype(np.int32)), found], ["head", "doc_id", "pos", "context"])

    return docs.mapInArrow(run, "head long, doc_id long, pos int, context binary")


def _of_bytes(column):
    """Contexts, none of them null, as a row of 2 * SIDE numbers each: a view of the column's own bytes."""
    import numpy as np
    import pyarrow as pa

    ends = np.frombuffer(column.buffers()[1], "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[ends[0] : ends[-1]], "<u4").reshape(len(column), 2 * SIDE)


def _has(column, n: int):
    """For each list of numbers under n, none of them null, and each number: whether the list has it."""
    import numpy as np

    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    has = np.zeros((len(column), n), dtype=bool)
    has[np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()] = True
    return has


def _stretches(batches) -> Iterator[tuple]:
    """Runs of successive rows of the sorted table: whether one starts anew, its first row, and its columns."""
    import numpy as np

    after = None
    for batch in batches:
        if not len(batch):
            continue
        row, head, doc, pos = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("row", "head", "doc_id", "pos"))
        context = _of_bytes(batch.column("context"))
        cuts = np.flatnonzero(np.diff(row) != 1) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
            yield row[lo] != after, int(row[lo]), head[lo:hi], doc[lo:hi], pos[lo:hi], context[lo:hi]
            after = row[hi - 1] + 1


def _pack(head, doc, pos, context) -> bytes:
    """A suffix as bytes: three numbers, then its context."""
    import numpy as np

    return np.array([head, doc, pos], dtype="<i8").tobytes() + context.tobytes()


def _unpack(record: bytes) -> tuple:
    import numpy as np

    return *np.frombuffer(record[:24], dtype="<i8").tolist(), np.frombuffer(record[24:], dtype="<u4")


def _run_starts(head):
    """For each row of sorted heads the first row with the same one."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    return np.repeat(starts, np.diff(np.concatenate([starts, [len(head)]])))


def _lead(records: list[bytes], columns: list) -> list:
    """Columns with unpacked records before them."""
    import numpy as np

    if not records:
        return columns
    return [np.concatenate([np.array(a), x]) for a, x in zip(zip(*map(_unpack, records), strict=True), columns, strict=True)]


def _state(columns: list) -> list[bytes]:
    """What rows after these must know: the first of the last run, then its last rows.

    These are the last row and, as far as they are of its document and less than MIN_WORDS before
    it, the rows before, and one more: so there is one that is apart from any row to come.
    """
    head, doc, pos, _ = columns
    at, first = len(head) - 1, int(_run_starts(head)[-1])
    while at > first and doc[at] == doc[-1] and pos[-1] - pos[at] < MIN_WORDS:
        at -= 1
    return [_pack(*(x[i] for x in columns)) for i in (first, *range(at, len(head)))]


def _ends(ordered: DataFrame) -> DataFrame:
    """One row for each stretch: its first row, its state at the end, and whether it is one run."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        out: list[dict] = []
        for new, row, *columns in _stretches(batches):
            one = bool((columns[0] == columns[0][0]).all())
            if new:
                out.append({"row": row, "state": _state(columns), "whole": one})
            else:
                last = out[-1]
                joined = last["state"][0][:8] == _pack(*(x[0] for x in columns))[:8]
                last |= {"state": _state(_lead(last["state"], columns)), "whole": last["whole"] and one and joined}
        yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("state", pa.list_(pa.binary())), ("whole", pa.bool_())]))

    return ordered.mapInArrow(run, "row long, state array<binary>, whole boolean")


def _before(ends: list) -> dict[int, list[bytes]]:
    """By the first row of each stretch: the state of the rows before it."""
    import numpy as np

    out: dict[int, list[bytes]] = {}
    before: list[bytes] = []
    for end in sorted(ends, key=lambda r: r["row"]):
        out[end["row"]] = before
        state = [bytes(x) for x in end["state"]]
        if before and end["whole"] and before[0][:8] == state[0][:8]:
            # One run from before to the end: its first is further back, and the last rows may be too.
            rows = [_unpack(x) for x in [*before, *state[1:]]]
            state = _state([np.array(x) for x in zip(*rows, strict=True)])
        before = state
    return out


def _extend(a, b):
    """Words by which pairs of contexts go on alike, to the right and to the left."""
    import numpy as np

    same = (a == b) & (a != 0)
    return (np.logical_and.accumulate(same[:, part], axis=1).sum(axis=1) for part in (slice(0, SIDE), slice(SIDE, 2 * SIDE)))


def _compare(ordered: DataFrame, before: dict[int, list[bytes]]) -> DataFrame:
    """``doc_id, begin, end, pos, head, source, shift, context``: matches of each suffix with the one before and with its run's first.

    source is the doc_id of the earlier place, and shift what leads from a position to the one there. The context is null.

    A suffix with windows in no match, which may stand in another of its run, gives a row with begin -1, in end the
    shifts of these windows, a bit each, and its context. Places in one text that overlap are no two places: the one before is the last that is apart.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        state: list[bytes] = []
        for new, row, *columns in _stretches(batches):
            if new:
                state = before.get(row, [])
            columns = _lead(state, columns)
            head, doc, pos, context = columns
            start, at = _run_starts(head), np.arange(len(head))

            def apart(rows, others, doc=doc, pos=pos):
                return (doc[rows] != doc[others]) | (pos[rows] - pos[others] >= MIN_WORDS)

            previous = at - 1
            waiting = at[len(state) :]
            while len(waiting):
                waiting = waiting[(previous[waiting] >= start[waiting]) & ~apart(waiting, np.maximum(previous[waiting], 0))]
                previous[waiting] -= 1
            # By shift, the windows that the text has around each head and that are in no match yet.
            after, ahead = (np.logical_and.accumulate(context[:, part] != 0, axis=1).sum(axis=1)[:, None] for part in (slice(0, SIDE), slice(SIDE, 2 * SIDE)))
            shifts = np.arange(SIDE + 1)
            todo = (shifts <= ahead) & (SIDE - shifts <= after) & (at >= len(state))[:, None]
            found = []
            for other in (previous, start):
                here = at[len(state) :]
                here = here[(other[here] >= start[here]) & (other[here] < here)]
                here = here if other is previous else here[start[here] != previous[here]]
                right, left = _extend(context[here], context[other[here]])
                good = (HEAD + right + left >= MIN_WORDS) & apart(here, other[here])
                here = here[good]
                todo[here] &= (shifts > left[good, None]) | (SIDE - shifts > right[good, None])
                found.append([doc[here], pos[here] - left[good], pos[here] + HEAD + right[good], pos[here], head[here], doc[other[here]], pos[other[here]] - pos[here]])
            # Open windows matter where a suffix is apart from others than these two. Rows between the first
            # of a run and what is carried over are not at hand, but may be there.
            others = previous - start - np.where((start == 0) & bool(state), 0, 1)
            rest = np.flatnonzero(todo.any(axis=1) & (others > 0))
            found.append([doc[rest], np.full(len(rest), -1), todo[rest] @ (1 << shifts), pos[rest], head[rest], doc[rest], np.zeros(len(rest), dtype=np.int64)])
            columns_out = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
            own = pa.array([None] * (len(columns_out[0]) - len(rest)) + [context[i].tobytes() for i in rest.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns_out, own], ["doc_id", "begin", "end", "pos", "head", "source", "shift", "context"])
            state = _state(columns)

    return ordered.mapInArrow(run, "doc_id long, begin long, end long, pos long, head long, source long, shift long, context binary")


def _hashes(head, context):
    """Hashes of windows around heads, by the numbers of words after the head and before it.

    Gives a function of (words after, words before, which) -> hashes and whether the text has these words.
    """
    import numpy as np

    nothing, full = np.zeros((len(head), 1), dtype=np.uint64), np.ones((len(head), 1), dtype=bool)
    sums, whole = [], []
    for part, base in ((context[:, :SIDE], _BYTE_BASE), (context[:, SIDE:], _WORD_BASE)):
        sums.append(np.concatenate([nothing, np.cumsum(_mix(part.astype(np.uint64) + np.uint64(1)) * _powers(base, SIDE), axis=1, dtype=np.uint64)], axis=1))
        whole.append(np.concatenate([full, np.logical_and.accumulate(part != 0, axis=1)], axis=1))

    def of(after, before, which):
        keys = _mix(head.view(np.uint64)[:, None] + _mix(sums[0][:, after]) + sums[1][:, before] * np.uint64(_BYTE_BASE) + _mix(which.astype(np.uint64)))
        return keys.view(np.int64), whole[0][:, after] & whole[1][:, before]

    return of


def _exploded(rows: DataFrame, carried: list[str], coarse: bool) -> DataFrame:
    """Rows ``key, part`` or ``key, shift`` beside carried columns, for rows with ``head`` and ``context``.

    Windows of MIN_WORDS words around a head differ by their shift, the words before the head. Coarse
    keys stand for PART shifts each: they hash the words that all windows of a part have. Equal windows
    have equal coarse keys; few others have. Fine keys hash the windows of a row's ``parts``. Rows that
    have ``todo`` give keys for the shifts alone that are its bits.
    """
    name = "part" if coarse else "shift"

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            head = batch.column("head").to_numpy(zero_copy_only=False).astype(np.int64)
            context = _of_bytes(batch.column("context"))
            if coarse:
                which = np.arange(-(-(SIDE + 1) // PART))
                after, before = SIDE - np.minimum(which * PART + PART - 1, SIDE), which * PART
            else:
                which = np.arange(SIDE + 1)
                after, before = SIDE - which, which
            keys, there = _hashes(head, context)(after, before, which)
            if not coarse:
                there &= _has(batch.column("parts"), which[-1] // PART + 1)[:, which // PART]
            if "todo" in batch.schema.names:
                todo = batch.column("todo").to_numpy()[:, None] >> np.arange(SIDE + 1) & 1 > 0
                there &= np.logical_or.reduceat(todo, which * PART, axis=1) if coarse else todo
            row, at = np.nonzero(there)
            taken = pa.RecordBatch.from_arrays([batch.column(k) for k in carried], carried).take(pa.array(row)) if carried else None
            columns = [taken.column(k) for k in carried] if carried else []
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, at]), pa.array(at.astype(np.int64)), *columns], ["key", name, *carried])

    schema = f"key long, {name} long" + "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in carried)
    return rows.mapInArrow(run, schema)


#: Shifts that one coarse key stands for.
PART = 9


def _by_windows(ordered: DataFrame, unresolved: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Matches of the unresolved windows of n suffixes with any of their runs: by the first place of each window around the head."""
    # Document and position as one number, which aggregates without a sort.
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32) + F.col("pos")
    mine = unresolved.select("head", "doc_id", F.col("pos").cast("int").alias("pos"), "context", F.col("end").alias("todo"))
    # The rows of runs that have an open suffix, as far as a filter of bounded size can tell. Keys hash the head, so
    # what rows of other heads pass shares no key with an open suffix; a join would send a common head to one task.
    rows = Filter(mine.select("head"), mine.count()).among(ordered.select("head", "doc_id", "pos", "context"), F.col("head"))
    # Of suffixes with equal surroundings the first place stands for all m of them.
    near = rows.groupBy("head", "context").agg(F.min(place).cast("decimal(38,0)").alias("first"), F.count("*").alias("m"))
    near = scratch.keep(near.withColumn("id", F.monotonically_increasing_id()), "near", rows=n)
    n = near.count()
    scratch.drop("ordered")
    coarse = scratch.keep(_exploded(near, ["id", "m"], True), "coarse", rows=4 * n)
    several = coarse.groupBy("key").agg(F.sum("m").alias("n")).where("n > 1").select("key")
    shared = scratch.keep(several.join(_exploded(mine, [], True).select("key").distinct().hint("merge"), "key", "left_semi"), "shared", rows=4 * n)
    parts = lambda keyed, by: keyed.join(shared.hint("merge"), "key", "left_semi").groupBy(*by).agg(F.collect_set("part").alias("parts"))
    firsts = _exploded(near.join(parts(coarse, ["id"]).hint("merge"), "id"), ["first"], False).groupBy("key").agg(F.min("first").cast("decimal(38,0)").alias("first"))
    source = F.floor(F.col("first") / F.lit(1 << 32)).cast("long")
    at = (F.col("first") - source.cast("decimal(38,0)") * F.lit(1 << 32)).cast("long")
    firsts = scratch.keep(firsts.select("key", source.alias("source"), at.alias("at")), "firsts", rows=(SIDE + 1) * n)
    scratch.drop("near", "coarse")
    scratch.settle()
    own = ["doc_id", "pos", "head"]
    windows = _exploded(mine.join(parts(_exploded(mine, own, True), own).hint("merge"), own), ["doc_id", "pos"], False)
    # Windows are many, so they go with few columns: the position and the shift, which is less than 64, as one.
    windows = windows.select("key", "doc_id", (F.shiftleft(F.col("pos").cast("long"), 6) + F.col("shift")).alias("spot"))
    pos = F.shiftright("spot", 6)
    apart = (F.col("doc_id") != F.col("source")) | (pos - F.col("at") >= MIN_WORDS)
    # Windows of one suffix that lead to one source by one shift all hold the head, so they make one range.
    found = windows.join(firsts.hint("merge"), "key").where(apart).select("doc_id", "source", pos.alias("pos"), (F.col("at") - pos).alias("shift"), (pos - F.col("spot").bitwiseAND(F.lit(63))).alias("begin"))
    ranges = found.groupBy("doc_id", "source", "pos", "shift").agg(F.min("begin").alias("begin"), F.max(F.col("begin") + MIN_WORDS).alias("end"))
    return ranges.select("doc_id", "begin", "end", "source", "shift")


class Ranges:
    """The words of a text joined by blanks, so that a range of them is a slice."""

    def __init__(self, data: bytes):
        import numpy as np

        words = data.split()
        self.n, self.joined = len(words), b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        self.starts, self.ends = (ends - sizes).tolist(), ends.tolist()

    def words(self, begin: int, end: int) -> bytes:
        return self.joined[self.starts[begin] : self.ends[end - 1]] if 0 <= begin < end <= self.n else b""

    def proof(self, begin: int, end: int) -> bytes:
        from xxhash import xxh3_128_digest

        return xxh3_128_digest(self.words(begin, end))


def merged(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(begins, ends, strict=True)):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def _asked(matches: DataFrame) -> DataFrame:
    """``doc_id, begin, end, source, shift``: proposed matches, joined where they overlap or touch and have one source and shift."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for doc_id, source, shift, ranges in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "source", "shift", "ranges")), strict=True):
                for begin, end in merged([x["begin"] for x in ranges], [x["end"] for x in ranges]):
                    for column, value in zip(rows, (doc_id, begin, end, source, shift), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "begin", "end", "source", "shift"])

    grouped = matches.groupBy("doc_id", "source", "shift").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    return grouped.mapInArrow(run, "doc_id long, begin long, end long, source long, shift long")


def _both_places(docs: DataFrame, asked: DataFrame, whole: bool, scratch: Scratch, table: str) -> DataFrame:
    """asked with ``own`` and ``other``: what stands at the two places, the words if whole and else their 128-bit hash.

    Texts that no range lies in stay where they are, as far as a filter of bounded size can tell.
    """
    sides = asked.select("doc_id", "begin", "end").union(asked.select("source", F.col("begin") + F.col("shift"), F.col("end") + F.col("shift")))
    places = scratch.keep(sides.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("ranges")), f"{table}-places")
    texts = Filter(places.select("doc_id"), places.count()).among(docs, F.col("doc_id"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            rows: list[list] = [[] for _ in range(4)]
            for doc_id, text, ranges in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "ranges")), strict=True):
                of = Ranges(text.encode("utf-8", "replace"))
                for x in ranges:
                    for column, value in zip(rows, (doc_id, x["begin"], x["end"], (of.words if whole else of.proof)(x["begin"], x["end"])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.binary())], ["doc_id", "begin", "end", "found"])

    found = texts.join(places.hint("merge"), "doc_id").mapInArrow(run, "doc_id long, begin long, end long, found binary")
    # Rows that repeat a doc_id may answer differently.
    found = scratch.keep(found.distinct(), f"{table}-found")
    there = found.toDF("source", "there", "there_end", "other")
    paired = asked.withColumn("there", F.col("begin") + F.col("shift")).withColumn("there_end", F.col("end") + F.col("shift")).join(there.hint("merge"), ["source", "there", "there_end"])
    paired = paired.join(found.withColumnRenamed("found", "own").hint("merge"), ["doc_id", "begin", "end"])
    paired = scratch.keep(paired.select("doc_id", "begin", "end", "source", "shift", "own", "other"), f"{table}-paired")
    scratch.drop(f"{table}-places", f"{table}-found")
    return paired


def _equal_stretches(read: DataFrame) -> DataFrame:
    """``doc_id, begin, end, source, proof``: the stretches of MIN_WORDS equal words or more of ranges that come with their words."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in pieces(batches):
            rows: list[list] = [[] for _ in range(5)]
            for row in batch.to_pylist():
                own, other = row["own"].split(), row["other"].split()
                at = 0
                for same, stretch in itertools.groupby(map(eq, own, other)):
                    n = sum(1 for _ in stretch)
                    if same and n >= MIN_WORDS:
                        for column, value in zip(rows, (row["doc_id"], row["begin"] + at, row["begin"] + at + n, row["source"], xxh3_128_digest(b" ".join(own[at : at + n]))), strict=True):
                            column.append(value)
                    at += n
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.binary())], ["doc_id", "begin", "end", "source", "proof"])

    return read.mapInArrow(run, "doc_id long, begin long, end long, source long, proof binary")


def _verified(docs: DataFrame, matches: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, begin, end, source, proof``: matches whose words are the same at both places; proof hashes them.

    Each table goes as soon as no later plan reads it, here and before: what stands at once counts, and
    the tables that matches came from are done with when the ranges are asked for.
    """
    asked = scratch.keep(_asked(matches), "asked")
    scratch.drop("matches", "shared", "firsts")
    scratch.settle()
    paired = _both_places(docs, asked, False, scratch, "hashed")
    scratch.drop("asked")
    out = paired.where("own = other").select("doc_id", "begin", "end", "source", F.col("own").alias("proof"))
    differ = paired.where("own <> other").select("doc_id", "begin", "end", "source", "shift").distinct()
    if not differ.isEmpty():
        out = out.unionByName(_equal_stretches(_both_places(docs, scratch.keep(differ, "differ"), True, scratch, "read")))
    return out.distinct()


def repeated_spans(docs: DataFrame, scratch: Scratch, hash_bits: int = HASH_BITS) -> DataFrame:
    """``doc_id, spans``: word ranges that stand in an earlier place too, MIN_WORDS long at least.

    docs has ``doc_id`` (not null) and ``text`` (not null). spans is a list of (begin, end, source,
    proof); ranges may overlap, source is the doc_id of the earlier place, and proof the 128-bit hash
    of the range's words, which tells rows apart that repeat a doc_id.
    """
    heads = scratch.keep(suffix_heads(docs), "heads")
    common = scratch.keep(heads.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head"), "common", rows=heads.count(), per_file=500_000)
    positions = heads.join(common.hint("merge"), "head", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    positions = scratch.keep(positions, "positions")
    n = positions.count()
    texts = Filter(positions.select("doc_id"), n).among(docs, F.col("doc_id"))
    found = scratch.keep(_with_contexts(texts.join(positions.hint("merge"), "doc_id"), hash_bits), "found", rows=n, per_file=DOC_ROWS)
    n = found.count()
    scratch.drop("heads", "common", "positions")
    dealt = found.repartitionByRange(parallelism(docs.sparkSession), "head", "doc_id", "pos").sortWithinPartitions("head", "doc_id", "pos")
    # Ids count rows in sorted order, with gaps between tasks.
    ordered = scratch.keep(dealt.withColumn("row", F.monotonically_increasing_id()), "ordered")
    scratch.drop("found")
    scratch.settle()
    ordered = ordered.sortWithinPartitions("row")
    matches = scratch.keep(_compare(ordered, _before(_ends(ordered).collect())), "matches")
    kind = ["doc_id", "begin", "end", "source", "shift"]
    open_matches = _by_windows(ordered, matches.where("begin < 0"), scratch, n)
    proven = _verified(docs, matches.where("begin >= 0").select(kind).unionByName(open_matches.select(kind)), scratch)
    return proven.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "source", "proof")).alias("spans"))


NEW = ["n_words", "n_dropped", "passages", "sources"]


def drop_repeats(docs: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """Cut repeated passages; docs with a new ``text`` and with ``n_words, n_dropped, passages, sources``.

    docs needs ``doc_id`` and ``text``; its other columns stay, whatever their names, save that
    columns with the new names, in any letter case, are replaced. Words are runs free of
    ``[\\x20\\x09-\\x0D]`` and are compared as they are. A passage of 50 words or more that stands in an
    earlier place too, by doc_id and then position, is cut there: its words go, and the white space
    after each; other text stays as it is. The first place keeps it. Two places in one text count if
    they start 50 words apart or more. A null text becomes the empty text. ``passages`` lists the word
    ranges that went, as pairs (begin, end), and ``sources`` the other doc_ids that they were found in.
    Rows with a null doc_id stay whole and are no place for others. Rows that repeat a doc_id are one
    document: none of them loses what another holds at the same position. An empty table gives no rows.

    hash_bits: of the hashes that propose matches, 32 at most. With fewer, more proposals fail.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    columns = docs.columns
    docs, names = text_and_rest(docs, tuple(NEW))
    docs = docs.withColumn("key", F.col("doc_id").cast("long"))
    ided = docs.where("key is not null").select(F.col("key").alias("doc_id"), "text")
    by_doc = scratch.keep(repeated_spans(ided, scratch, hash_bits), "spans", rows=ided.count(), per_file=DOC_ROWS).withColumnRenamed("doc_id", "key")
    scratch.drop("differ", "hashed-paired", "read-paired")
    scratch.settle()
    passed = docs.drop("text", "key").schema
    schema = StructType([*passed.fields, *StructType.fromDDL(_FIELDS).fields])

    def cut(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            texts, n_words, n_dropped, passages, sources = [], [], [], [], []
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * len(batch)
            for doc_id, text, gone in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), spans, strict=True):
                if gone:
                    data = text.encode("utf-8", "replace")
                    of = Ranges(data)
                    gone = [x for x in gone if of.proof(x["begin"], x["end"]) == x["proof"]]
                if not gone:
                    texts.append(text)
                    n_words.append(len(text.encode("utf-8", "replace").split()))
                    n_dropped.append(0)
                    passages.append([])
                    sources.append([])
                    continue
                starts, ends = word_spans(data)
                ranges = merged([x["begin"] for x in gone], [x["end"] for x in gone])
                parts, at = [], 0
                for begin, end in ranges:
                    parts.append(data[at : starts[begin]])
                    at = starts[end] if end < len(starts) else ends[end - 1]
                texts.append(b"".join([*parts, data[at:]]).decode("utf-8", "replace"))
                n_words.append(len(starts))
                n_dropped.append(sum(e - b for b, e in ranges))
                passages.append([{"begin": b, "end": e} for b, e in ranges])
                sources.append(sorted({x["source"] for x in gone} - {doc_id}))
            new = [pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(passages, kind), pa.array(sources, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed.names), *new], [*passed.names, "text", *NEW])

    # Texts that nothing was found in stay where they are, as far as a filter of bounded size can tell.
    found = Filter(by_doc.select("key"), by_doc.count())
    moved = found.among(docs, F.col("key")).join(by_doc.hint("merge"), "key", "left")
    out = moved.mapInArrow(cut, schema).unionByName(found.others(docs, F.col("key")).mapInArrow(cut, schema))
    return with_names(out, names, NEW, columns)
