"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

A dozen overlapping heuristics judge a text good or bad or say nothing. No true label is used:
expectation-maximisation (``weak.LabelModel``) estimates their accuracies from how they agree on all
documents, as numbers of each pattern of votes. Its posterior labels of a bounded sample train a
linear model over hashed features, which scores all documents in one pass and without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_SPACE, pieces, ship, text_and_rest, text_column, with_names
from .weak import LabelModel, fit_linear

#: Documents that the linear model is fitted on at most, those with the smallest hashes of their doc_id.
SAMPLE_ROWS = 8192
BUCKETS = 1 << 16
THRESHOLD = 0.5
#: Words of the blocks in which the variety of words is measured, so that it means the same in a long text.
BLOCK = 100

_PLAIN = b".,;:'\"-?()"


def measures(text: str) -> tuple[dict[str, float], dict[str, float]]:
    """Named measures of a whole text, and the shares of characters that are no letter, digit or space.

    Shares of characters come twice: among all characters, and among the last ones of words.
    """
    import numpy as np

    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    counts = np.bincount(data, minlength=256)
    space = np.isin(data, np.frombuffer(ASCII_SPACE, dtype=np.uint8))
    last = np.bincount(data[~space & np.append(space[1:], True)] if len(data) else data, minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    beyond = (counts[128:].sum() + 1) // 2
    letters = max(1, upper + lower + beyond)
    visible = max(1, len(data) - int(space.sum()))
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    strange = sum(int(counts[c]) for c in signs if c not in _PLAIN)
    blocks = [len(set(words[i : i + BLOCK])) / len(words[i : i + BLOCK]) for i in range(0, n, BLOCK) if n < BLOCK or i + BLOCK <= n]
    named = {
        "words": float(n),
        "upper": upper / letters,
        "digits": digits / visible,
        "strange": strange / visible,
        "ends": sum(int(last[c]) for c in signs if c not in _PLAIN) / max(1, n),
        "bars": (int(counts[ord("|")]) + int(counts[ord("\t")])) / max(1, n),
        "shouts": int(counts[ord("!")]) / max(1, n),
        "variety": sum(blocks) / len(blocks) if blocks else 1.0,
        "again": sum(map(eq, words, words[1:])) / max(1, n - 1),
        "top": max(Counter(words).values()) / n if n else 0.0,
        "length": len(text) / max(1, n),
        "stops": (int(last[ord(".")]) + int(last[ord(",")]) + int(last[ord("?")])) / max(1, n),
        "lines": 1 - len(set(lines)) / len(lines),
    }
    shares = {f"{kind}{chr(c)}": int(of[c]) / total for kind, of, total in (("in", counts, visible), ("end", last, max(1, n))) for c in signs if of[c]}
    return named, shares


#: For each labeller: its measure, the words a text must have for it to speak, good up to, bad from, first guess of its accuracy.
#: Bad lies below good where the first limit is the greater one.
LABELLERS = [
    ("upper", 3, 0.3, 0.6, 0.8),
    ("strange", 3, 0.03, 0.08, 0.8),
    ("ends", 3, 0.05, 0.25, 0.8),
    ("bars", 5, 0.03, 0.15, 0.8),
    ("shouts", 5, 0.05, 0.3, 0.8),
    ("variety", 20, 0.5, 0.35, 0.7),
    ("again", 10, 0.05, 0.2, 0.8),
    ("top", 20, 0.2, 0.35, 0.7),
    ("length", 5, 12.0, 20.0, 0.6),
    ("stops", 50, 0.04, 0.01, 0.6),
    ("lines", 5, 0.2, 0.6, 0.6),
    ("digits", 5, 0.2, 0.5, 0.6),
]


#: Labellers whose measure speaks for good prose too, not only for the lack of one fault.
BOTH_WAYS = ("variety", "stops")


def votes_of(named: dict[str, float]) -> list[int]:
    """1 for bad, 0 for good, -1 for nothing.

    A labeller of one fault says nothing of the others, so it votes bad or not at all; those of
    BOTH_WAYS vote for either. The last two are for texts without a word and for what the limits say
    together: two faults are bad, and a text that is on the good side of all limits is good.
    """
    out, good_for_all = [], named["words"] > 0
    for name, least, good, bad, _ in LABELLERS:
        x, sign = named[name], 1 if bad > good else -1
        speaks = named["words"] >= least
        fine = sign * x <= sign * good
        out.append(1 if speaks and sign * x >= sign * bad else 0 if speaks and fine and name in BOTH_WAYS else -1)
        good_for_all = good_for_all and (not speaks or fine)
    faults = out.count(1)
    out.append(1 if named["words"] == 0 else -1)
    out.append(1 if faults >= 2 else 0 if good_for_all else -1)
    return out


def features_of(named: dict[str, float], shares: dict[str, float]) -> list[int]:
    """Buckets of the hashed features: each measure and share in steps of a logarithmic scale."""
    from xxhash import xxh3_64_intdigest

    out = {f"{name}={round(2 * math.log2(x + 1e-3))}" for name, x in named.items()}
    out |= {f"{name}~{round(math.log2(x))}" for name, x in shares.items() if x >= 0.01}
    out |= {f"vote{i}={v}" for i, v in enumerate(votes_of(named))}
    return sorted({xxh3_64_intdigest(x.encode()) % BUCKETS for x in out})


class QualityModel:
    """Weights of the hashed features. Plain data: goes to executors as it is."""

    def __init__(self, weights: dict[int, float], bias: float, accuracy: dict[str, float]):
        self.weights, self.bias, self.accuracy = weights, bias, accuracy

    @classmethod
    def fit(cls, texts: list[str]) -> QualityModel:
        """Fit on texts. ``fit_quality`` does the same on a cluster."""
        found = [measures(x) for x in texts]
        votes = [tuple(votes_of(named)) for named, _ in found]
        return cls.train(Counter(votes), votes, [features_of(*x) for x in found])

    @classmethod
    def train(cls, patterns: dict[tuple[int, ...], int], votes: list[tuple[int, ...]], rows: list[list[int]]) -> QualityModel:
        """The label model from the number of documents of each pattern of votes, the linear one from votes and features of some."""
        if not patterns:
            return cls({}, 50.0, {})
        import numpy as np

        each = sorted(patterns)
        model = LabelModel([x[4] for x in LABELLERS] + [0.9, 0.9], prior=0.15).fit(np.array(each, dtype=np.int8), [patterns[x] for x in each])
        used = sorted({x for row in rows for x in row})
        place = {x: i for i, x in enumerate(used)}
        targets = 1 - model.posterior(np.array(votes, dtype=np.int8).reshape(len(votes), len(each[0])))
        weights, bias = fit_linear([[place[x] for x in row] for row in rows], targets, len(used))
        names = [x[0] for x in LABELLERS] + ["empty", "all"]
        return cls({x: float(weights[i]) for x, i in place.items()}, bias, dict(zip(names, model.accuracy.tolist(), strict=True)))

    def score(self, text: str) -> float:
        """How likely a text is good, 0 to 1."""
        z = self.bias + sum(self.weights.get(x, 0.0) for x in features_of(*measures(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """The label model from the votes on all documents, the linear model from sample_rows of them at most.

    Texts stay on the executors. To the driver come the number of documents of each pattern of votes,
    of which there are fewer than 2**21 by the number of labellers, and votes and features of the
    sample: of documents that repeat a doc_id the greatest text.
    """
    ship(docs.sparkSession)
    docs = text_column(docs)

    def vote(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            found = Counter(bytes(x + 1 for x in votes_of(measures(text)[0])) for text in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(found.values(), pa.int64())], ["votes", "n"])

    def look(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            found = [measures(x) for x in batch.column("text").to_pylist()]
            votes = [bytes(x + 1 for x in votes_of(named)) for named, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.binary()), pa.array([features_of(*x) for x in found], pa.list_(pa.int32()))], ["doc_id", "votes", "features"])

    votes_in = lambda data: tuple(x - 1 for x in bytes(data))
    counts = docs.select("text").mapInArrow(vote, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    sample = sorted(rows.mapInArrow(look, "doc_id long, votes binary, features array<int>").collect(), key=lambda r: r["doc_id"])
    return QualityModel.train({votes_in(r["votes"]): r["n"] for r in counts}, [votes_in(r["votes"]) for r in sample], [r["features"] for r in sample])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``quality_score`` (0 to 1) and ``kept`` (boolean: at least the threshold), one row for each.

    The whole ``text`` alone is looked at; a null text is empty and comes back so. An empty text has no
    words, which a labeller takes for bad. Rows that repeat or lack a doc_id are scored like any other.
    Other columns stay, whatever their names, save that columns with the new names, in any letter
    case, are replaced. Without documents to fit on every text is good.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    plain, names = text_and_rest(docs, ("quality_score", "kept"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            scores = pa.array(map(model.score, batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "quality_score"])

    out = plain.mapInArrow(run, StructType([*plain.schema.fields, *StructType.fromDDL("quality_score double").fields])).withColumn("kept", F.col("quality_score") >= threshold)
    return with_names(out, names, ["quality_score", "kept"], columns)


def quality(docs: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on docs and score every row of it."""
    return score_quality(docs, fit_quality(docs, sample_rows), threshold)
