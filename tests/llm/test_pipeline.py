"""The pipeline's stages and its whole run against plain Python on the smallest tables."""

import zlib
from collections import defaultdict

import pytest

pytest.importorskip("stratalith.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from fixtures import packed  # noqa: E402
from test_suffix_dedup import repeated_words  # noqa: E402
from test_topk_and_simhash import _classes, _reference_print  # noqa: E402

from stratalith.llm.suffix_dedup import word_spans  # noqa: E402
from stratalith.llm.tokens import vocabulary_path  # noqa: E402
from stratalith.llm.toxicity import ToxicityModel  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def plain_toxicity(docs, labels):
    train = sorted((i, t, x) for i, t in docs for j, x in labels.items() if i == j and zlib.crc32(str(i).encode()) % 4 != 2)
    model = ToxicityModel.fit([t for _, t, _ in train], [x for _, _, x in train])
    return [(i, t) for i, t in docs if model.score(t) < 0.3]


def plain_lines(docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for i, t in docs:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    stays = lambda i, line: len(holders[key(line)]) < 2 or min(holders[key(line)]) == i
    return [(i, "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in docs]


def plain_near(docs):
    roots = _classes([_reference_print(t) for _, t in docs])
    least = {r: min(i for (i, _), x in zip(docs, roots) if x == r) for r in roots}
    return [(i, t) for (i, t), x in zip(docs, roots) if i == least[x]]


def plain_passages(docs):
    docs = sorted(docs)
    gone = repeated_words([(i, [w for w in t.encode().split()]) for i, t in docs])
    out = []
    for i, t in docs:
        data = t.encode()
        starts, ends = word_spans(data)
        text, at = b"", 0
        for p in range(len(starts)):
            if p in gone[i]:
                if p == 0 or p - 1 not in gone[i]:
                    text += data[at : starts[p]]
                at = starts[p + 1] if p + 1 < len(starts) else ends[p]
        out.append((i, (text + data[at:]).decode()))
    return out


def test_each_stage_and_the_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    plain = [lambda d: plain_toxicity(d, labels), plain_lines, plain_near, plain_passages]
    for k, ((name, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, plain)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = sorted(brute(now))
        rows = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == now, name
        if k:
            assert all(r["n_chars"] == len(r["text"]) for r in rows)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    whole = {i: packed([*library.encode(t, add_special_tokens=False).ids, 1]) for i, t in now}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == whole


def test_awkward_documents(spark):
    from fixtures import documents

    docs = documents(spark, extra=[(None, "null id"), (12, "again"), (12, "again")]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
