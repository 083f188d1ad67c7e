"""Toxicity by weak supervision.

A bounded sample of labelled rows gives a lexicon: words, and beginnings of words, that stand in
toxic texts more than in others. Its entries and patterns of their number and density are voters. A
generative label model (``weak.LabelModel``) estimates their accuracies and correlations, the given
label being one voter among them that may err too. A linear classifier is trained on the posterior
labels; it alone scores the documents, in one pass and without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, pieces, ship, text_and_rest, text_column, with_names
from .weak import LabelModel, fit_linear

#: Labelled rows that the model is fitted on at most, those with the smallest hashes of their doc_id.
SAMPLE_ROWS = 8192
THRESHOLD = 0.3
#: Lengths of word beginnings, entries of the lexicon at most, toxic texts of the sample that an entry needs, and the
#: least logarithm of its ratio of shares and the least likelihood ratio.
PREFIXES = (3, 4, 5, 6, 7, 8)
ENTRIES = 200
SUPPORT = 3
LIFT, GAIN = 1.0, 10.0
#: Candidates for the lexicon that come to the driver at most, the best by likelihood ratio.
CANDIDATES = 50_000

_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def entries_of(words: set[str]) -> set[str]:
    """The words themselves, and their beginnings, which end with a star."""
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def patterns(hits: int, n_words: int) -> list[int]:
    """The features that the number and the density of lexicon entries give."""
    density = hits / max(1, n_words)
    tests = [hits >= n for n in (1, 2, 3, 5)] + [density > d for d in (0.002, 0.005, 0.01, 0.02, 0.04, 0.08)] + [n_words < 30, n_words > 300]
    return [i for i, true in enumerate(tests) if true]


N_PATTERNS = 12


def signature(text: str) -> list[int]:
    """Four min-hashes of a text's three-word shingles, as signed 64-bit numbers."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    shingles = {" ".join(words[k : k + 3]).encode("utf-8", "replace") for k in range(max(1, len(words) - 2))}
    return [min(xxh3_64_intdigest(s, seed) for s in shingles) - (1 << 63) for seed in range(4)]


def distinct_texts(signatures: list[list[int]]) -> list[int]:
    """Positions of one text of each group of near copies: those that share a min-hash."""
    parent = list(range(len(signatures)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, own in enumerate(signatures):
        for slot in enumerate(own):
            a, b = find(i), find(seen.setdefault(slot, i))
            parent[max(a, b)] = min(a, b)
    return [i for i in range(len(signatures)) if find(i) == i]


def counted(found: list, toxic: list[bool]) -> dict[str, tuple[int, int]]:
    """For each entry the toxic texts and all texts that have it."""
    hits, total = Counter(), Counter()
    for words, t in zip(found, toxic, strict=True):
        entries = entries_of(set(words))
        total.update(entries)
        if t:
            hits.update(entries)
    return {x: (hits[x], n) for x, n in total.items()}


def mine(counts: dict[str, tuple[int, int]], n: int, n_toxic: int, most: int = ENTRIES) -> list[tuple[str, int, int]]:
    """``entry, toxic texts, texts`` of the lexicon, by the likelihood ratio of their counts, ``most`` at most.

    An entry goes if a shorter beginning of it is as precise, or if longer ones account for most of
    its toxic texts.
    """
    if not 0 < n_toxic < n:
        return []

    def likelihood(k: int, of: int, p: float) -> float:
        return sum(c * math.log(q) for c, q in ((k, p), (of - k, 1 - p)) if c)

    rated = []
    for x, (a, total) in counts.items():
        if a < SUPPORT:
            continue
        b = total - a
        lift = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n - n_toxic + 1))
        gain = 2 * (likelihood(a, n_toxic, a / n_toxic) + likelihood(b, n - n_toxic, b / (n - n_toxic)) - likelihood(a, n_toxic, total / n) - likelihood(b, n - n_toxic, total / n))
        if lift >= LIFT and gain >= GAIN:
            rated.append((-round(gain, 6), x.endswith("*"), -len(x), x))
    chosen: list[str] = []
    precision = {x: a / total for x, (a, total) in counts.items()}
    for _, _, _, x in sorted(rated):
        stem = x.rstrip("*")
        shorter = [y for y in chosen if stem.startswith(y.rstrip("*"))]
        longer = [y for y in chosen if y not in shorter and y.startswith(stem)]
        if any(precision[y] >= precision[x] - 0.1 for y in shorter) or sum(counts[y][0] for y in longer) >= 0.7 * counts[x][0]:
            continue
        chosen.append(x)
        if len(chosen) == most:
            break
    return [(x, *counts[x]) for x in chosen]


class ToxicityModel:
    """A lexicon and a linear classifier over its entries and patterns. Plain data: goes to executors as it is."""

    def __init__(self, entries: dict[str, float], patterns: list[float], bias: float):
        self.entries, self.patterns, self.bias = entries, patterns, bias
        self.lengths = sorted({len(x) - 1 for x in entries if x.endswith("*")})

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], entries: int = ENTRIES) -> ToxicityModel:
        """Fit on texts and labels; without both kinds of label every score is 0. ``fit_toxicity`` does the same on a cluster."""
        kept = distinct_texts([signature(x) for x in texts])
        found, toxic = [words_of(texts[i]) for i in kept], [labels[i] == 1 for i in kept]
        lexicon = mine(counted(found, toxic), len(kept), sum(toxic), entries)
        place = {x: i for i, (x, _, _) in enumerate(lexicon)}
        return cls.train(lexicon, [sorted(place[x] for x in entries_of(words) if x in place) for words in found], [len(x) for x in found], toxic)

    @classmethod
    def train(cls, lexicon: list[tuple[str, int, int]], own: list[list[int]], n_words: list[int], toxic: list[bool]) -> ToxicityModel:
        """Label model and linear classifier, from the entries that each text has, its number of distinct words, and its label."""
        import numpy as np

        if not lexicon:
            return cls({}, [0.0] * N_PATTERNS, -50.0)
        place = {x: i for i, (x, _, _) in enumerate(lexicon)}
        hits, sizes = np.array([len(x) for x in own]), np.array([max(1, n) for n in n_words])
        density = hits / sizes

        votes = np.full((len(own), len(lexicon) + 6), -1, dtype=np.int8)
        for i, x in enumerate(own):
            votes[i, x] = 1
        judge = [
            (np.where(hits == 0, 0, np.where(hits >= 2, 1, -1)), 0.8),
            (np.where(hits >= 3, 1, -1), 0.8),
            (np.where(density > 0.02, 1, np.where(density < 0.003, 0, -1)), 0.7),
            (np.where(density > 0.01, 1, 0), 0.7),
            (np.where(density > 0.05, 1, -1), 0.8),
            (np.array(toxic, dtype=np.int8), 0.9),
        ]
        for k, (vote, _) in enumerate(judge):
            votes[:, len(lexicon) + k] = vote
        start = [(a + 0.5) / (b + 1) for _, a, b in lexicon] + [x for _, x in judge]
        model = LabelModel(start, prior=sum(toxic) / len(toxic), anchor=True).fit(votes)
        rows = [[*(N_PATTERNS + j for j in x), *patterns(len(x), int(n))] for x, n in zip(own, sizes, strict=True)]
        weights, bias = fit_linear(rows, model.posterior(votes), N_PATTERNS + len(lexicon))
        return cls({x: float(weights[N_PATTERNS + i]) for x, i in place.items()}, weights[:N_PATTERNS].tolist(), bias)

    def score(self, text: str) -> float:
        words = words_of(text)
        entries = self.entries
        hits = [w for w in words if w in entries]
        for n in self.lengths:
            hits += {x for w in words if len(w) > n and (x := w[:n] + "*") in entries}
        z = self.bias + sum(map(entries.__getitem__, hits)) + sum(self.patterns[i] for i in patterns(len(hits), max(1, len(words))))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def held_out():
    """Whether a row of labels is kept from training, by the checksum of its doc_id as text."""
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> ToxicityModel:
    """Fit on at most sample_rows labelled rows that are not held out, with a lexicon of at most ``entries`` entries.

    labels needs ``doc_id`` and ``toxic``; rows with a null in either are no labels. Of repeated labels
    the greatest counts, and of documents that repeat a doc_id the greatest text. The sampled ids,
    whose number is the bound, are broadcast. Texts stay on the executors: to the driver come four
    hashes a sampled text, counts of the lexicon's CANDIDATES at most, and a sampled text's entries.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = text_column(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def look(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            words = pa.array([list(words_of(x)) for x in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), words, pa.array(map(signature, texts), pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "signature"])

    sample = scratch.keep(rows.mapInArrow(look, "doc_id long, toxic int, words array<string>, signature array<long>"), "sample")
    seen = sample.select("doc_id", "toxic", "signature").orderBy("doc_id").collect()
    kept = [seen[i] for i in distinct_texts([r["signature"] for r in seen])]
    if not kept:
        return ToxicityModel.train([], [], [], [])
    n, n_toxic = len(kept), sum(r["toxic"] == 1 for r in kept)
    sample = sample.join(F.broadcast(spark.createDataFrame([(r["doc_id"],) for r in kept], "doc_id long")), "doc_id")

    def count(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            found = counted(batch.column("words").to_pylist(), [x == 1 for x in batch.column("toxic").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["entry", "hits", "total"])

    counts = sample.select("words", "toxic").mapInArrow(count, "entry string, hits long, total long").groupBy("entry").agg(F.sum("hits").alias("a"), F.sum("total").alias("total"))
    # The tests of ``mine`` with a margin for rounding, so that only what may pass them comes to the driver.
    term = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    side = lambda k, of, p: term(k, p) + term(of - k, 1 - p)
    a, b, share, clean = F.col("a"), F.col("total") - F.col("a"), F.col("total") / n, max(1, n - n_toxic)
    lift = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    gain = 2 * (side(a, F.lit(n_toxic), a / max(1, n_toxic)) + side(b, F.lit(clean), b / clean) - side(a, F.lit(n_toxic), share) - side(b, F.lit(clean), share))
    rated = counts.where(a >= SUPPORT).where(lift >= LIFT - 0.01).withColumn("gain", gain).where(F.col("gain") >= GAIN - 0.01)
    best = rated.orderBy(F.desc("gain"), "entry").limit(CANDIDATES).collect()
    lexicon = mine({r["entry"]: (r["a"], r["total"]) for r in best}, n, n_toxic, entries)
    place = {x: i for i, (x, _, _) in enumerate(lexicon)}

    def match(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            words = batch.column("words").to_pylist()
            own = [sorted(place[x] for x in entries_of(set(w)) if x in place) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array([len(w) for w in words], pa.int32())], ["doc_id", "toxic", "own", "n_words"])

    matched = sorted(sample.select("doc_id", "toxic", "words").mapInArrow(match, "doc_id long, toxic int, own array<int>, n_words int").collect())
    scratch.drop("sample")
    return ToxicityModel.train(lexicon, [r["own"] for r in matched], [r["n_words"] for r in matched], [r["toxic"] == 1 for r in matched])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``toxicity`` (0 to 1) and ``toxic`` (boolean: at least the threshold), one row for each.

    The whole ``text`` alone is looked at; a null text is empty and comes back so, and an empty text gets
    the score of a text without any hit. Rows that repeat or lack a doc_id are scored like any other.
    Other columns stay, whatever their names, save that columns with the new names, in any letter
    case, are replaced. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    plain, names = text_and_rest(docs, ("toxicity", "toxic"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            scores = pa.array(map(model.score, batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "toxicity"])

    out = plain.mapInArrow(run, StructType([*plain.schema.fields, *StructType.fromDDL("toxicity double").fields])).withColumn("toxic", F.col("toxicity") >= threshold)
    return with_names(out, names, ["toxicity", "toxic"], columns)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every row of docs.

    An empty table of documents gives no rows; without labels of both kinds every score is 0.
    """
    return score_toxicity(docs, fit_toxicity(docs, labels, sample_rows, entries), threshold)
