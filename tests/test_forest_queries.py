"""Queries on forests, over vectors of which one component tells the label."""

import time
import tracemalloc

import numpy as np
import pytest

from stratalith.operators import forest, model
from stratalith.plans import catalog
from stratalith.sources import scratch


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """4000 vectors with labels from 0 to 3 by component 10, e1_b2, of which a tenth are wrong: so trees are deep."""
    rng = np.random.default_rng(3)
    x, y = rng.random((4000, 64)), rng.integers(0, 10, 4000)
    right = rng.random(4000) < 0.9
    y[right] = (x[right, 9] * 4).astype(int)
    folder = tmp_path_factory.mktemp("planted")
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_ranks_the_component_that_tells(spark, planted):
    began = time.time()
    got = sorted(catalog.QUERIES["q64b"](spark, planted).collect(), key=lambda r: r["rank"])
    assert len(got) == 20 and got[0]["feature"] == "e1_b2" and got[0]["epoch"] == "e1"
    assert got[0]["importance"] > 3 * got[1]["importance"]
    assert time.time() - began < 60


def test_hold_out_of_the_best_features(spark, planted):
    began = time.time()
    (got,) = catalog.QUERIES["q64c"](spark, planted).collect()
    assert got["n_features"] == 20 and 1000 < got["n_held_out"] < 1400 and got["accuracy"] > 0.8
    assert time.time() - began < 100


def test_predicts_all_rows_and_gaps_as_nothing(spark, planted):
    began = time.time()
    got = catalog.QUERIES["q65b"](spark, planted).collect()
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{planted}/embeddings.parquet").select("vec_id", "label").collect()}
    assert sorted(r["pid"] for r in got) == sorted(labels)
    assert all(r["predicted"] == 0 for r in got if r["pid"] % 17 == 0)
    whole = [r for r in got if r["pid"] % 17]
    assert sum(r["predicted"] == labels[r["pid"]] for r in whole) > 0.9 * len(whole)
    assert time.time() - began < 60


def test_a_split_of_many_classes_takes_few_numbers_a_row():
    """The best splits are those of trying all, and what is held at once does not grow with the classes."""
    rng = np.random.default_rng(8)
    n, classes, features, nodes, width = 10_000, 200, 5, 3, 40
    x, y, w = rng.integers(0, width, (n, features)).astype(np.uint8), rng.integers(0, classes, n), rng.integers(1, 4, n)
    y[x[:, 2] > 25] //= 2
    node, taken = rng.integers(0, nodes, n), np.array([[4, 2, 0], [1, 2, 3], [3, 0, 1]])
    counts = np.bincount(node * classes + y, w, nodes * classes).reshape(nodes, classes)
    tracemalloc.start()
    feature, cut, score, left = forest._search(x, y, w, node, counts, taken, 50, width)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 30 * 8 * n
    for k in range(nodes):
        best = -1.0
        for f in taken[k].tolist():
            for c in range(width - 1):
                here = (node == k) & (x[:, f] <= c)
                lower = np.bincount(y[here], w[here], classes)
                upper = counts[k] - lower
                if min(lower.sum(), upper.sum()) >= 50:
                    best = max(best, (lower @ lower) / lower.sum() + (upper @ upper) / upper.sum())
        at = (node == k) & (x[:, feature[k]] <= cut[k])
        assert feature[k] in taken[k] and np.isclose(score[k], best) and (left[k] == np.bincount(y[at], w[at], classes)).all()
        assert np.isclose((left[k] @ left[k]) / left[k].sum() + ((counts[k] - left[k]) ** 2).sum() / (counts[k] - left[k]).sum(), best)


@pytest.mark.parametrize("classes", [2, 10, 300])
def test_histograms_and_sorted_rows_give_the_same_splits(classes):
    """Whichever way a node is searched, all of a split is the same, whether its sums share a number or not."""
    rng = np.random.default_rng(classes)
    n, features, nodes, width = 6000, 9, 40, 128
    x, y, w = rng.integers(0, width, (n, features)).astype(np.uint8), rng.integers(0, classes, n), rng.integers(1, 4, n)
    y[x[:, 4] > 90] //= 2
    node = np.minimum(rng.integers(0, 4000, n), nodes - 1)  # one of nearly all rows, some of one or two
    counts, taken = np.bincount(node * classes + y, w, nodes * classes).reshape(nodes, classes), forest._taken(rng, nodes, features)
    with pytest.MonkeyPatch.context() as patch:
        found = []
        for cells, cached in ((0, 1), (0, 1 << 20), (1 << 40, 1), (1 << 40, 1 << 22), (10, 1 << 15)):
            patch.setattr(forest, "CELLS", cells)
            patch.setattr(forest, "CACHED", cached)
            found.append(forest._search(x, y, w, node, counts, taken, 1, width))
    assert (found[0][0] >= 0).any()
    for other in found[1:]:
        assert all((a == b).all() for a, b in zip(found[0], other, strict=True))


def test_trees_take_eight_bytes_a_node():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 128, (3000, 20)).astype(np.uint8), rng.integers(0, 2, 3000)
    tree, _ = forest._grow(x, y, np.ones(3000, dtype=np.int64), 2, 0, model.Forest(), [1])
    feature, cut, child, dist = tree.written()
    assert len(feature) + len(cut) + len(child) == 8 * len(tree.feature)
    for again in (forest._Tree.read(feature, cut, child, dist, 2), forest._Tree.read(tree.feature.astype("<i4").tobytes(), tree.cut.astype("<i4").tobytes(), child, dist, 2)):
        assert (again.feature == tree.feature).all() and (again.cut == tree.cut).all() and (again.dist[again.child[again.ends(x)]].argmax(axis=1) == y).mean() > 0.9


@pytest.mark.parametrize("query", ["q64c", "q65b"])
def test_rows_are_written_once_and_bins_found_once(spark, planted, query):
    made, cuts = [], []
    with pytest.MonkeyPatch.context() as patch:
        keep, find = scratch.Scratch.keep, forest._cuts
        patch.setattr(scratch.Scratch, "keep", lambda self, df, table, *a, **k: made.append(table) or keep(self, df, table, *a, **k))
        patch.setattr(forest, "_cuts", lambda *a: cuts.append(1) or find(*a))
        catalog.QUERIES[query](spark, planted)
    assert made.count("rows") == 1 and len(cuts) == 1
