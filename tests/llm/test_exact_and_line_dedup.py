import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("stratalith.llm.queries")
from fixtures import SCHEMA, documents  # noqa: E402

from stratalith.llm import common, exact_dedup  # noqa: E402
from stratalith.llm.line_dedup import dedup_lines  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"


def test_rice_code_round_trip():
    rng = np.random.default_rng(3)
    for k in (0, 1, 7, 20):
        for gaps in ([], [0], rng.integers(0, 1 << (k + 3), 500).tolist()):
            got = exact_dedup.rice_decode(*exact_dedup.rice_encode(gaps, k), k, len(gaps))
            assert got.tolist() == gaps


@pytest.mark.parametrize("spare", [8, 0])
def test_exact_duplicates_against_brute_force(spark, monkeypatch, spare):
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", spare)  # without spare bits nearly all rows are suspects
    monkeypatch.setattr(exact_dedup, "OWNER_FINGERPRINTS", 4)
    docs = documents(spark, extra=[(None, "Same text again"), (None, "null id"), (7, "twice"), (7, "twice"), (3, " Same text again")]).repartition(3)
    groups = defaultdict(list)
    for r in docs.collect():
        groups["".join(c for c in r["text"] or "" if c not in SPACE)].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        stayed = False
        for m in sorted(members, key=lambda m: (m[0], m[1], m[2] or 0)):
            kept = not stayed and m == best
            stayed |= kept
            want[m[2], best[2], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == want


def test_line_dedup_against_brute_force(spark):
    texts = ["A long enough LINE\nshort\nA long enough LINE", "\ta long enough line \nown words of this one\nshort", None, "", "own words of this one", "ÄÖÜäöüßéèê\nx", "äöüäöüßéèê\ny", "ÄÖÜäöüßéèê", "repeats only inside\nrepeats only inside", "\n\n" + "z" * 100_000 + "\n"]
    docs = documents(spark, texts, extra=[(None, "a long enough line"), (11, "a long enough line\nextra words here")]).repartition(3)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    all_rows = docs.collect()
    for r in all_rows:
        for line in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and len(key(line)) >= 10:
                holders[key(line)].add(r["doc_id"])
    want = Counter()
    for r in all_rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if r["doc_id"] is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == r["doc_id"]]
        want[r["doc_id"], r["source"], r["hi"], "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = dedup_lines(docs).select("doc_id", "source", "hi", "text", "n_lines", "n_dropped")
    assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert dedup_lines(empty).count() == 0


def test_few_messages_and_few_texts(spark, monkeypatch):
    """Blocks grow with the table, and a filter picks the suspects' texts, all of them and few others."""
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(exact_dedup, "BLOCKS_MOST", 8)
    docs = spark.createDataFrame([(i, f"text {i % 390}") for i in range(400)], "doc_id long, text string").repartition(20)
    parts = exact_dedup._blocks(docs)
    blocks = exact_dedup._joined(parts, 400).collect()
    assert len(blocks) <= 8 and sum(b["n"] for b in blocks) == 400
    assert Counter(r["group_size"] for r in exact_dedup.exact_duplicates(docs).collect()) == {1: 380, 2: 20}
    keys = docs.where("doc_id < 10").select("doc_id")
    found = common.Filter(keys, 10)
    passed = {r["doc_id"] for r in found.among(docs, F.col("doc_id")).collect()}
    assert set(range(10)) <= passed and len(passed) < 60
    assert {r["doc_id"] for r in found.others(docs, F.col("doc_id")).collect()} == set(range(400)) - passed
    nulls = spark.createDataFrame([(None, "x"), (3, "y")], docs.schema)
    assert [r["text"] for r in found.others(nulls, F.col("doc_id")).collect()] == ["x"]
    monkeypatch.setattr(common, "FILTER_WORDS", 1)  # a filter that is too small lets all through
    assert common.Filter(docs.select("doc_id"), 400).among(docs, F.col("doc_id")).count() == 400


def test_lines_of_three_documents(spark):
    docs = documents(spark, ["in two documents\nin three documents", "in two documents\nin three documents", "in three documents\nin three documents"])
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, min_documents=3).collect()}
    assert got == {10: "in two documents\nin three documents", 11: "in two documents", 12: ""}
