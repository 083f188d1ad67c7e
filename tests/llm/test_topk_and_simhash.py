import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("stratalith.llm.queries")
from fixtures import SCHEMA, documents  # noqa: E402

from stratalith.llm import simhash, topk  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, score long, part string, block string"


def vectors(spark, n=130, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(n)]
    rows += [(200 + i, [1.0, 0.5, 0.0, 0.0, -1.0, 2.0]) for i in range(40)]  # ties
    rows += [(0, [0.5] * 6), (300, [0.25] * 6), (300, [0.25] * 6)]  # repeated ids
    rows += [(400, None), (420, []), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [math.nan] * 6), (480, [math.inf] * 6), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [3.0, 2.0]), (520, [1.0] * 3), (540, [-3000.0, 1e4, 0.0, 0.0, 0.0, 0.0])]
    return spark.createDataFrame([(i, e, 1, 2, "p", "b") for i, e in rows], VECTORS), rows


def best(rows, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for q, a in ok:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k]))
    return want


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    table, rows = vectors(spark)
    got = topk.top_k(table.repartition(3), F.col("vec_id") % 20 == 0, k=7)
    assert Counter(map(tuple, got.collect())) == best(rows, 7)


def _cut(ids, cells, matrix, kept):
    return ids[kept], topk.Cells(cells.low, cells.high, cells.width, cells.codes[kept]), matrix[kept]


def test_top_k_reads_few_exact_vectors():
    """By the approximations alone most vectors are left out; of the others a search reads until it is certain."""
    rng = np.random.default_rng(1)
    matrix, queries, ids = rng.integers(-100, 100, (2000, 32)).astype(float), rng.integers(-100, 100, (3, 32)).astype(float), np.arange(2000)
    cells = topk.Cells.of(matrix)
    upper, lower = cells.bounds(queries)
    exact = queries @ matrix.T
    assert (lower <= 2 * exact).all() and (2 * exact <= upper).all()
    certain = topk.best_of(lower, 20).min(axis=1)
    needed = (upper >= certain[:, None]).any(axis=0)
    assert needed.sum() < 250
    found = topk.Search(np.array([-1, -2, -3]), queries, 20, certain)
    found.take(*_cut(ids, cells, matrix, needed))
    assert found.read < 300
    for i in range(3):
        assert [-s for s, _ in found.best[i]] == sorted(exact[i].astype(int).tolist(), reverse=True)[:20]


def test_numbers_beyond_doubles(spark):
    """Sums that neither doubles nor 64-bit products hold on the way are exact; a score that no long holds raises."""
    rows = [(0, [1.0, 0.0, 2.0**-6]), (1, [2.0**50, 1.0, 3.0]), (2, [2.0**50, -5.0, 2.0]), (3, [-(2.0**45), 2.0**40, 1.0]), (20, [2.0**-6, 2.0**-6, 0.5]), (5, [2.0**50 + 1, 0.0, 0.0])]
    table = spark.createDataFrame([(i, e, 1, 2, "p", "b") for i, e in rows], VECTORS.replace("float", "double"))
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=3)
    whole = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    want = Counter()
    for q in (0, 20):
        scored = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3]))
    assert Counter(map(tuple, got.collect())) == want
    large = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e30, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="[Oo]verflow|too large|too big"):
        topk.top_k(large, F.col("vec_id") == 0).collect()


def test_top_k_of_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def _reference_print(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _classes(prints):
    """Component of each position by brute force."""
    out = list(range(len(prints)))

    def find(x):
        while out[x] != x:
            x = out[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                out[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs through the forest until night falls on the quiet hills " * 6
    texts = [base, base + "once more", base.upper(), base.replace("lazy", "sleepy", 1), "other words entirely in this text", None, "", " \n", "one", "One", "one two", "x " * 50_000]
    docs = documents(spark, texts, extra=[(None, base), (None, "only null id here now"), (11, "repeated"), (3, "one two")]).repartition(3)
    rows = docs.collect()
    prints = [_reference_print(r["text"] or "") for r in rows]
    roots = _classes(prints)
    least = {root: min((r["doc_id"] for r, x in zip(rows, roots) if x == root and r["doc_id"] is not None), default=None) for root in roots}
    want = Counter((r["doc_id"], f"{p:016x}", least[x]) for r, p, x in zip(rows, prints, roots))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of(F.col("fp")), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    kept = Counter(r["doc_id"] for r in simhash.keep_one(docs).collect())
    stay = {r["doc_id"] for r, x in zip(rows, roots) if r["doc_id"] == least[x]} | {None}
    assert kept == Counter(r["doc_id"] for r in rows if r["doc_id"] in stay)


def _moved(df) -> int:
    """Bytes that the plan of df shuffles."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            total += plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Where the ids that go are too many to broadcast, only texts that may go are sent; once a text in ten here."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 700).tolist())) for _ in range(200)]
    documents(spark, texts + texts[:20]).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k, None) for k in names]
    try:
        for k in names:
            spark.conf.set(k, "-1")
        out = simhash.keep_one(docs)
        assert out.count() == 200 and _moved(out) < 0.4 * sum(map(len, texts))
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("bucket", [10_000, 40])
def test_links_of_many_close_fingerprints(spark, monkeypatch, bucket):
    """Fingerprints around a few centres, against all pairs; small buckets are cut into chunks."""
    rng = np.random.default_rng(7)
    prints = []
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.int64).tolist():
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.append(centre ^ sum(1 << int(b) for b in flips))
    prints = sorted({p if p < 1 << 63 else p - (1 << 64) for p in prints})
    made = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n: made)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, []), bucket=bucket).collect()}
    roots = _classes([p % (1 << 64) for p in prints])
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert got == {i: least[r] for i, r in enumerate(roots)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
