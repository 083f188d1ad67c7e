import random
import re
from pathlib import Path

import pytest

pytest.importorskip("stratalith.llm.queries")
from fixtures import SCHEMA, TEXTS, documents  # noqa: E402

from stratalith.llm import suffix_dedup  # noqa: E402
from stratalith.llm.suffix_dedup import drop_repeats  # noqa: E402


def repeated_words(docs):
    """For each (doc_id, text) in order, the word positions in a run of 50 that stands in an earlier place too."""
    first, out = {}, {}
    for doc_id, words in docs:
        gone = set()
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            where = first.setdefault(key, (doc_id, i))
            if where[0] != doc_id or i - where[1] >= 50:
                gone.update(range(i, i + 50))
        out[doc_id] = gone
    return out


def _planted(rng, n_docs=60, n_passages=8):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(rng.choice([50, 51, 55, 70, 120, 400])) for _ in range(n_passages)]
    short = words(49)
    texts = []
    for _ in range(n_docs):
        parts = [words(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice([*passages, short]), words(rng.randrange(1, 90))]
        texts.append(parts)
    for period in (1, 7, 30, 49, 50, 80):
        texts.append([words(rng.randrange(9)), words(period) * (200 // period), words(rng.randrange(9))])
    texts += [texts[3], texts[5] + [words(60)], [passages[0]], [words(20), passages[1], words(30), passages[1]]]
    space = lambda: rng.choice([" ", " ", "\n", " \t "])
    return ["".join(w + space() for part in parts for w in part) for parts in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "parallelism", lambda spark: 7)  # runs go over the borders of parts
    texts = _planted(random.Random(seed))
    docs = documents(spark, texts).repartition(3)
    want = repeated_words([(10 + i, t.split()) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in drop_repeats(docs).collect()}
    for i, text in enumerate(texts):
        row = got[10 + i]
        gone = {p for b, e in row["passages"] for p in range(b, e)}
        assert gone == want[10 + i], i
        assert row["n_dropped"] == len(gone) and row["n_words"] == len(text.split())
        assert row["text"].split() == [w for p, w in enumerate(text.split()) if p not in gone]
        assert (row["source"], row["hi"]) == ("src", 1)
        for other in row["sources"]:  # each shares a window with this text
            shared = set(zip(*(texts[other - 10].split()[k:] for k in range(50)), strict=False)) & set(zip(*(text.split()[k:] for k in range(50)), strict=False))
            assert other < 10 + i and shared


def test_passages_that_share_their_middle(spark):
    """A common middle of 30 words within many surroundings, each of which comes twice, far apart in doc_id."""
    rng = random.Random(9)
    words = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    middle = words(30)
    around = [(words(rng.randrange(0, 40)), words(rng.randrange(0, 40))) for _ in range(25)]
    texts = [" ".join(words(12) + a + middle + b + words(12)) for _ in range(2) for a, b in around]
    want = repeated_words([(10 + i, t.split()) for i, t in enumerate(texts)])
    got = {r["doc_id"]: {p for b, e in r["passages"] for p in range(b, e)} for r in drop_repeats(documents(spark, texts).repartition(3)).collect()}
    assert got == want and sum(map(len, want.values())) > 500


def test_equal_copies_apart_in_their_run(spark):
    """Two whole copies with other documents of their only head before and between them."""
    rng = random.Random(11)
    words = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    kept = lambda text: suffix_dedup.Words(" ".join(text).encode()).kept().tolist()
    while True:
        text = words(55)
        at = kept(text)
        if len(at) != 1 or not 4 <= at[0] <= 30:
            continue
        middle = text[at[0] - 4 : at[0] + 20]
        others = [words(60) + middle + words(60) for _ in range(2)]
        if all(64 in kept(other) for other in others):
            break
    texts = [others[0], text, others[1], text]
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeats(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert got == {10: 0, 11: 0, 12: 0, 13: 55}


def test_words_after_a_passage_that_agree_in_few_bits(spark):
    """Words after a passage, some pair of which agrees in 16 bits of its hashes, are no part of it."""
    seen = {}
    for i in range(5000):
        word = f"after{i}"
        other = seen.setdefault(int(suffix_dedup.Words(word.encode()).hashes[0]) >> 40 & 0xFFFF | 1, word)
        if other != word:
            break
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [f"one {passage} {other} end", f"two {passage} {word} finish"]
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeats(documents(spark, texts)).collect()}
    assert other != word and got == {10: 0, 11: 60}


@pytest.mark.parametrize("bits", [1, 2])
def test_no_word_is_cut_that_hashes_alone_repeat(spark, bits):
    """With hashes of so few bits most proposals are wrong; what is cut still stands elsewhere, word for word."""
    texts = _planted(random.Random(5), n_docs=30)
    shared = " ".join(f"s{i}" for i in range(49))
    texts += [f"{shared} one", f"{shared} two", f"three {shared}", f"four {shared} five"]
    allowed = repeated_words([(10 + i, t.split()) for i, t in enumerate(texts)])
    got = {r["doc_id"]: {p for b, e in r["passages"] for p in range(b, e)} for r in drop_repeats(documents(spark, texts).repartition(3), hash_bits=bits).collect()}
    assert all(got[k] <= allowed[k] for k in allowed)
    assert sum(map(len, got.values())) > sum(map(len, allowed.values())) / 2


def test_copies_of_unequal_length(spark):
    """Cut-outs of passages, which share more with some others of their run than with the one before and the first."""
    rng = random.Random(12)
    words = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        passage = words(100)
        for begin, end in [(0, 60), (0, 80), (0, 60), (0, 80), (20, 90), (25, 75), (10, 100)]:
            texts.append(" ".join(words(40) + passage[begin:end] + words(40)))
        o, a, middle, b, q, r, s = words(50), words(28), words(24), words(28), words(50), words(50), words(50)
        texts += [" ".join(t) for t in (o + middle + b, a + middle + q, r + middle + s, a + middle + b)]
    rng.shuffle(texts)
    want = repeated_words([(10 + i, t.split()) for i, t in enumerate(texts)])
    got = {r["doc_id"]: {p for b, e in r["passages"] for p in range(b, e)} for r in drop_repeats(documents(spark, texts).repartition(3)).collect()}
    assert got == want and sum(map(len, want.values())) > 5000


def test_one_passage_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "parallelism", lambda spark: 16)
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [f"own{i} start{i} {passage} end{i} own{i}" for i in range(400)]
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeats(documents(spark, texts).repartition(4)).collect()}
    assert got == {10 + i: 60 if i else 0 for i in range(400)}


def test_awkward_rows(spark):
    docs = documents(spark, [*TEXTS, "word " * 500, "never said before " + " ".join(map(str, range(100)))], extra=[(None, " ".join(map(str, range(100)))), (27, " ".join(map(str, range(100)))), (27, "other text")])
    got = drop_repeats(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["n_dropped"] == 0
    assert by[26][0]["n_dropped"] == 450  # the first 50 words of a repeated word stay
    # Rows of one id are one document.
    assert sorted(r["n_dropped"] for r in by[27]) == [0, 0, 0]
    untouched = [r for r in got if r["n_dropped"] == 0 and r["doc_id"] == 15]
    assert untouched[0]["text"] == TEXTS[5]


def test_empty_table(spark):
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_and_contexts_of_sliced_batches():
    import numpy as np
    import pyarrow as pa

    from stratalith.llm import suffix_dedup

    lists = pa.array([[3], [0, 2], [], [1, 1]], pa.list_(pa.int64()))
    want = np.array([[0, 0, 0, 1], [1, 0, 1, 0], [0, 0, 0, 0], [0, 1, 0, 0]], dtype=bool)
    rows = np.arange(4 * 2 * suffix_dedup.SIDE, dtype="<u4").reshape(4, -1)
    for kind in (pa.binary(), pa.large_binary()):
        contexts = pa.array([x.tobytes() for x in rows], kind)
        for a, b in ((0, 4), (1, 3), (2, 2), (3, 4)):
            assert (suffix_dedup._has(lists[a:b], 4) == want[a:b]).all()
            assert (suffix_dedup._of_bytes(contexts[a:b]) == rows[a:b]).all()


def test_tables_go_when_no_plan_reads_them(spark, tmp_path, monkeypatch):
    """Of the tables on the way no more than the spans are left, and the matches are gone before texts are read again."""
    from stratalith.llm import suffix_dedup

    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + 120])) for i in range(30)], "doc_id long, text string")
    made, asked = [], []
    real = suffix_dedup._both_places

    def watched(docs, ranges, whole, scratch, table):
        made.append(scratch)
        asked.append({p.name for p in Path(scratch.root.removeprefix("file:").replace("//", "/")).iterdir()})
        return real(docs, ranges, whole, scratch, table)

    monkeypatch.setattr(suffix_dedup, "_both_places", watched)
    got = suffix_dedup.drop_repeats(docs)
    assert {x for x in asked[0] if not x.startswith(".")} == {"asked"}
    assert sum(r["n_dropped"] for r in got.collect()) > 0
    assert {p.name for p in Path(made[0].root.removeprefix("file:").replace("//", "/")).iterdir() if not p.name.startswith(".")} == {"spans"}


def test_rows_of_a_common_head_are_dealt_by_their_surroundings(spark, monkeypatch):
    """A join by head would send all rows of a common one to one task."""
    plans = {}

    class Kept(suffix_dedup.Scratch):
        def keep(self, df, table, *args, **named):
            plans[table] = df._jdf.queryExecution().executedPlan().toString()
            return super().keep(df, table, *args, **named)

    monkeypatch.setattr(suffix_dedup, "Scratch", Kept)
    assert drop_repeats(documents(spark, TEXTS)).count() == len(TEXTS)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plans["near"])
    assert dealt and all("head" in x and "context" in x for x in dealt)
