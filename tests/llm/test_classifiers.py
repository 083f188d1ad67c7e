import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("stratalith.llm.queries")
from fixtures import SCHEMA, TEXTS, documents  # noqa: E402

from stratalith.llm.quality import QualityModel, fit_quality, quality, score_quality  # noqa: E402
from stratalith.llm.toxicity import ToxicityModel, fit_toxicity, held_out, toxicity  # noqa: E402
from stratalith.llm.weak import LabelModel, fit_linear  # noqa: E402

SF = "/root/testdata/sf0.1"


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    n = 6000
    truth = rng.random(n) < 0.3
    true_accuracy = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(n) < a, truth, ~truth).astype(int) for a in true_accuracy], axis=1)
    votes = np.concatenate([votes, votes[:, 2:3], votes[:, 2:3]], axis=1)  # the third voter three times
    votes[rng.random(votes.shape) < 0.1] = -1
    model = LabelModel([0.7] * 6, prior=0.3).fit(votes)
    assert np.abs(model.accuracy[:4] - true_accuracy).max() < 0.06
    assert model.correlation[2, 4] > 0.5 > abs(model.correlation[0, 1])
    assert model.weight[2] < 0.6 < model.weight[0]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_linear_model_learns_soft_targets():
    w, b = fit_linear([[0], [1], [0, 1], []] * 50, [0.9, 0.1, 0.5, 0.5] * 50, 2)
    assert w[0] > 1 > -1 > w[1] and abs(b) < 0.2
    assert fit_linear([], [], 3)[0].tolist() == [0, 0, 0]


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    positive = np.asarray(labels) == 1
    return (rank[positive].mean() - (positive.sum() - 1) / 2) / (~positive).sum()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels.withColumnRenamed("toxic", "label").select("doc_id", "label"), "doc_id").where(held_out()).collect()
    label, predicted = np.array([r["label"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert _auc(np.array([r["toxicity"] for r in rows]), label) > 0.95
    assert (predicted & (label == 1)).sum() / label.sum() > 0.85
    assert (predicted & (label == 1)).sum() / predicted.sum() > 0.85


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.001/%s.parquet" % t) for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    a, b = ({r["doc_id"]: r["toxicity"] for r in toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in labels.select("doc_id", held_out().alias("h")).collect())


def test_toxicity_of_awkward_tables(spark):
    docs = documents(spark, extra=[(None, "no id"), (12, "again")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert len(got) == docs.count() and all(0 <= r["toxicity"] < 0.01 and not r["toxic"] for r in got)
    odd = spark.createDataFrame([(None, 1), (10, None), (12, 1), (12, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity(docs, odd).count() == docs.count()
    assert toxicity(spark.createDataFrame([], SCHEMA), odd).count() == 0
    texts = [f"good words number{i} here" for i in range(60)] + [f"vile nasty words number{i}" for i in range(60)]
    model = ToxicityModel.fit(texts, [0] * 60 + [1] * 60)
    assert model.score("") < 0.5 < model.score("vile nasty things")


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality(docs).join(labels.select("doc_id", "quality"), "doc_id").collect()
    label, kept = np.array([r["quality"] for r in rows]), np.array([r["kept"] for r in rows])
    assert _auc(np.array([r["quality_score"] for r in rows]), label) > 0.95
    assert kept[label == 1].mean() > 0.97
    assert kept[label == 0].mean() < 0.1


def test_quality_of_awkward_tables(spark):
    docs = documents(spark, extra=[(None, "no id"), (12, "again")])
    got = quality(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0
    assert all(r["kept"] for r in score_quality(documents(spark, TEXTS), QualityModel.fit([])).collect())
    rng = random.Random(1)
    prose = [" ".join(rng.choice(["the", "river", "runs", "past", "old", "stones,", "slowly."]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(80)) for _ in range(80)]
    junk = ["BUY!! NOW!! " * 30, "a | b | c | d | e | " * 20, "x*** y&&& z$$$ " * 30] * 5
    model = QualityModel.fit(prose + junk)
    assert model.score(prose[0]) > 0.5 > model.score(junk[0])


def test_fits_on_a_cluster_equal_fits_in_one_place(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    given = sorted((r["doc_id"], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts)
    plain = ToxicityModel.fit([texts[i] for i, _ in given], [x for _, x in given])
    model = fit_toxicity(docs.repartition(5), labels)
    assert model.entries == plain.entries and model.patterns == plain.patterns and model.bias == plain.bias
    few = fit_toxicity(docs, labels, entries=5)
    assert 0 < len(few.entries) <= 5
    quality_model, in_one_place = fit_quality(docs.repartition(5)), QualityModel.fit([texts[i] for i in sorted(texts)])
    assert quality_model.weights == in_one_place.weights and quality_model.accuracy == in_one_place.accuracy


def test_a_repeated_doc_id_is_one_row_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(3000)] + [(2, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(ToxicityModel, "train", classmethod(lambda cls, lexicon, own, n_words, toxic: seen.append(len(own)) or cls({}, [0.0] * 12, -50.0)))
    monkeypatch.setattr(QualityModel, "train", classmethod(lambda cls, patterns, votes, rows: seen.append((sum(patterns.values()), len(rows))) or cls({}, 0.0, {})))
    fit_toxicity(docs, labels)
    fit_toxicity(docs, labels, sample_rows=1)
    fit_quality(docs, sample_rows=1)
    assert seen[0] <= 2 and seen[1] <= 1 and seen[2] == (3001, 1)
