"""Goldens, invariants and gates of the operators."""

import math
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stratalith.functions import indices, names, scaling
from stratalith.operators import curate, evaluate, focal, forest, graph, model, overlay, paint, radar, segment, shape, temporal, texture, vote, zonal
from stratalith.operators import grid as cells_of
from stratalith.operators.order import percentiles, running_id
from stratalith.sources import io
from stratalith.streaming.epochs import epoch_aggregates, follow


def cells(spark, array, name="v"):
    array = np.asarray(array)
    rows = [(int(r * array.shape[1] + c), int(r), int(c), array[r, c].item()) for r in range(array.shape[0]) for c in range(array.shape[1])]
    kind = "int" if array.dtype.kind == "i" else "double"
    return spark.createDataFrame([(p, r, c, None if v != v else v) for p, r, c, v in rows], f"pid long, r int, c int, {name} {kind}")


def to_array(df, name, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", name).collect():
        out[row[0], row[1]] = np.nan if row[2] is None else row[2]
    return out


def test_published_confusion(spark):
    matrix = [[11, 5, 2], [7, 7, 0], [1, 2, 5]]
    pairs = spark.createDataFrame([(i, j) for i in range(3) for j in range(3) for _ in range(matrix[i][j])], "y_true int, y_pred int")
    table = evaluate.confusion(pairs, [0, 1, 2])
    accuracy, kappa = evaluate.accuracy_kappa(table).first()
    assert accuracy == 0.575 and round(kappa, 4) == 0.3241
    f1 = {r["label"]: round(r["f1"], 4) for r in evaluate.per_class(table).collect()}
    assert f1 == {0: 0.5946, 1: 0.5, 2: 0.6667}


def test_confusion_keeps_empty_classes(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (9, 9)], "y_true int, y_pred int")
    table = evaluate.confusion(pairs, [0, 1, 2])
    assert table.count() == 9 and table.agg(F.sum("n")).first()[0] == 2
    assert [tuple(r) for r in evaluate.per_class(table).where("label = 2").collect()] == [(2, 0.0, 0.0, 0.0, 0)]


def test_shape_of_a_block(spark):
    grid = np.zeros((5, 6), dtype=int)
    grid[1:3, 1:4] = 7
    row = shape.shape_features(cells(spark, grid, "lab"), "lab", 1.0).first()
    assert (row["area_m2"], row["perimeter_m"], row["elongation"], row["fill_ratio"]) == (6.0, 10.0, 1.5, 1.0)
    assert round(row["compactness"], 5) == 0.75398
    corner = np.zeros((5, 6), dtype=int)
    corner[:2, :3] = 7
    assert shape.shape_features(cells(spark, corner, "lab"), "lab", 1.0).first()["perimeter_m"] == 5.0
    whole = shape.shape_features(cells(spark, np.full((3, 3), 2), "lab"), "lab", 1.0).first()
    assert whole["perimeter_m"] == 0 and whole["compactness"] is None


def test_index_range_is_not_interpolated(spark):
    both = spark.createDataFrame([(1, float(x)) for x in range(1, 12)] + [(2, float(x)) for x in (1, 2, 3, 4, 10)] + [(3, None)], "seg int, v double")
    assert {r["seg"]: r["range"] for r in zonal.index_range(both, "v").collect()} == {1: 8.0, 2: 9.0}


def test_plurality_drops_ties(spark):
    votes = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (1, "B"), (2, "A"), (2, "A"), (2, "B"), (3, "A")], "segment int, label string")
    assert {tuple(r) for r in vote.plurality(votes, "segment", "label").collect()} == {(2, "A", 2), (3, "A", 1)}
    named = spark.createDataFrame([(1, 5, " Natural "), (1, 5, "Natural"), (1, 5, "Odd"), (2, 4, "Natural"), (3, 5, None)], "segment int, class int, subtype string")
    got = vote.plurality_within(named, "segment", F.col("class") == 5, F.col("subtype"), model.SUBTYPES, "final_id")
    assert [tuple(r) for r in got.collect()] == [(1, 5, 2)]
    assert [r[0] for r in vote.unknown_names(named, "subtype", model.SUBTYPES).collect()] == ["Odd"]


def test_flat_segment_has_no_texture(spark):
    flat = spark.createDataFrame([(1, 3.0)] * 4, "seg int, v double")
    stats = zonal.zonal_mean_std(flat, ["v"]).first()
    assert (stats["size"], stats["v__mean"], stats["v__std"]) == (4, 3.0, 0.0)
    assert zonal.entropy(flat.withColumn("q", F.lit(5)), "q").first()["entropy"] == 0
    assert tuple(zonal.variation_and_deviation(flat, "v").first()) == (1, 0.0, 0.0)


def test_wide_zonal_batches(spark):
    wide = spark.createDataFrame([(1, 2.0), (1, None), (2, None), (0, 5.0)], "seg int, v double")
    features = [f"f{k}" for k in range(100)]
    out = zonal.zonal_mean_std(wide.withColumns({f: F.col("v") + k for k, f in enumerate(features)}), features)
    rows = {r["seg"]: r for r in out.collect()}
    assert set(rows) == {1, 2} and rows[1]["f99__mean"] == 101.0 and rows[2]["f0__mean"] is None and rows[1]["size"] == 2


def test_harmonic_recovers_a_wave(spark):
    values = [3 + 2 * math.cos(2 * math.pi * d / 365.25) + math.sin(2 * math.pi * d / 365.25) for d in names.DAYS]
    df = spark.createDataFrame([(values,)], "x array<double>")
    got = df.select(*(v.alias(k) for k, v in temporal.harmonic(F.col("x"), names.DAYS).items())).first()
    assert np.allclose([got["offset"], got["amp"], got["phase"]], [3, math.sqrt(5), math.atan2(1, 2)])


def test_temporal_gaps(spark):
    df = spark.createDataFrame([([None, 4.0, None, 1.0, 10.0, 3.0, 2.0],), ([None] * 7,)], "x array<double>")
    x = F.col("x")
    rows = df.select(temporal.percentile(x, 0.1).alias("p"), temporal.std(x).alias("s"), temporal.change(x, 0, 1).alias("d")).collect()
    assert round(rows[0]["p"], 9) == 1.4 and round(rows[0]["s"], 9) == round(float(np.std([4, 1, 10, 3, 2])), 9) and rows[0]["d"] is None
    assert tuple(rows[1]) == (None, None, None)


def test_indices(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.random((50, 8)) + 0.05], [f"b{k}" for k in range(1, 9)])
    band = lambda n: F.col(f"b{n}")
    legacy, new = indices.legacy_indices(band), indices.extended_indices(band)
    assert set(new) == set(names.EXTENDED) and set(legacy) == set(names.LEGACY)
    assert df.where(new["GNDVI"] != legacy["NDVI"]).count() == 0  # band 4 is green in one and red in the other
    zero = spark.createDataFrame([(-2.0, 0.0)], "vv double, vh double")
    assert zero.select(indices.radar_indices(F.col("vv"), F.lit(2.0))["RVI"]).first()[0] is None
    gap = df.select(*(F.lit(None).cast("double").alias(c) if c == "b6" else F.col(c) for c in df.columns)).limit(1)
    made = gap.select(*(v.alias(k) for k, v in new.items()), indices.linear_to_db(F.col("b6")).alias("db"), cells_of.snap_floor(F.col("b6"), 0.0, 1.0, 5).alias("at")).first()
    assert {k for k, v in made.asDict().items() if v is None} == {"RENDVI", "SAVI", "OSAVI", "MSAVI2", "ARVI", "VARI", "BSI", "db", "at"}
    assert zero.select(indices.linear_to_db(F.col("vh")), indices.digital_number_to_db(F.col("vh"))).first()[:] == (-100.0, None)


def test_feature_names():
    assert len(names.legacy_names()) == 138 and len(names.temporal_names()) == 28
    assert len(names.feature_names()) == len(set(names.feature_names())) == 266
    assert len(names.feature_names(["march"], temporal=False)) == 8 + 4 + 16 + 2 + 10


def test_families_follow_their_order(spark):
    want = {"aug25_OSAVI__mean": "SAVI_Indices", "maxNDVI": "Temporal_MinMaxStd", "p50NDVI__mean": "Temporal_Percentiles", "aug_b8": "Spectral_Bands", "maxndvi": "Other", "tree_height_mean": "Tree_Height", "slope__mean": "Topography", "march_EVI__std": "EVI_Indices"}
    df = names.dictionary(spark, list(want))
    assert {r[0]: r[1] for r in df.select("name", names.family(F.col("name"))).collect()} == want
    assert names.dictionary(spark, ["aug25_b1"]).select(names.epoch(F.col("name"))).first()[0] == "aug25"


def test_snap(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (0.5,), (1.0,), (1.5,), (2.5,), (99.0,)], "x double")
    got = df.select(cells_of.snap_floor(F.col("x"), 0.0, 1.0, 10), cells_of.snap_round(F.col("x"), 0.0, 1.0, 10)).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 2), (2, 2), (9, 9)]


def test_scaling(spark):
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in odd.select(scaling.finite(F.col("v"))).collect()] == [1.0, None, None, None]
    flat = spark.createDataFrame([(7.0,), (7.0,), (None,)], "v double")
    assert [r["x"] for r in scaling.min_max(flat, "v", "x", F.lit(True)).collect()] == [0.0, 0.0, None]
    assert [r["q"] for r in scaling.quantise(flat, "v", "q").collect()] == [0, 0, 255]
    assert [r["x"] for r in scaling.byte_stretch(flat.where("v is null"), "v", "x").collect()] == [0]
    half = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)], "v double")
    assert [r["q"] for r in scaling.quantise(half, "v", "q", levels=3, low=0.0, high=1.0).orderBy("v").collect()] == [0, 0, 1, 2, 2]


def test_compact_keeps_zero(spark):
    grid = np.array([[5, 5, 9], [9, 2, 2]])
    out = zonal.compact(cells(spark, grid, "lab"), "lab")
    assert to_array(out, "segment_id", grid.shape).tolist() == [[2, 2, 3], [3, 1, 1]]
    grid[0, 0] = 0
    assert to_array(zonal.compact(cells(spark, grid, "lab"), "lab"), "segment_id", grid.shape)[0, 0] == 0


def test_running_id(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = running_id(spark.createDataFrame(rows, "k int").repartition(5), ["k"], "id").collect()
    assert sorted((r["k"], r["id"]) for r in got) == [(k, k + 1) for k in range(1000)]
    assert running_id(spark.createDataFrame([], "k int"), ["k"], "id").count() == 0


@pytest.mark.parametrize("radius", [1, 2, 10])
def test_focal_mean_and_std(spark, radius):
    a = np.random.default_rng(radius).random((23, 17))
    pad = np.pad(a, radius, mode="symmetric")
    stack = np.stack([pad[radius + dr : radius + dr + 23, radius + dc : radius + dc + 17] for dr, dc in focal.circle(radius)])
    out = focal.focal_mean_std(cells(spark, a), "v", radius)
    assert np.allclose(to_array(out, "mean", a.shape), stack.mean(axis=0))
    assert np.allclose(to_array(out, "std", a.shape), stack.std(axis=0), atol=1e-7)


def test_tree_height_takes_gaps_as_ground(spark):
    a = np.ones((9, 9))
    a[4, 4] = np.nan
    out = to_array(focal.tree_height(cells(spark, a), "v", 30.0), "mean", a.shape)
    assert out[0, 0] == 1.0 and round(out[4, 4], 9) == 0.8


def test_focal_mode(spark):
    grid = np.array([[0, 1, 1], [0, 0, 2], [3, 0, 0]])
    got = to_array(focal.focal_mode(cells(spark, grid, "lab"), "lab"), "mode", grid.shape)
    assert got.astype(int).tolist() == [[1, 1, 1], [3, 1, 1], [3, 3, 2]]


def test_components_and_invariance(spark):
    rng = np.random.default_rng(8)
    grid = (rng.random((30, 30)) < 0.6).astype(int)
    got = graph.cell_components(cells(spark, grid, "x").where("x = 1"))
    labels = {(r["r"], r["c"]): r["component"] for r in got.collect()}
    seen = {}
    for start in sorted(labels):
        if start in seen:
            continue
        stack, root = [start], start[0] * 30 + start[1]
        while stack:
            p = stack.pop()
            if p in seen or p not in labels:
                continue
            seen[p] = root
            stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert labels == seen


def test_segmentation_is_valid(spark):
    rng = np.random.default_rng(5)
    a = np.repeat(np.repeat(rng.random((4, 4)) * 100, 8, axis=0), 8, axis=1) + rng.random((32, 32))
    out = segment.segment(cells(spark, a, "b"), ["b"], spatial_radius=2, range_radius=12.0, least=20)
    labels = to_array(out, "region", a.shape)
    sizes = {k: int((labels == k).sum()) for k in np.unique(labels)}
    assert sum(sizes.values()) == 1024 and min(sizes.values()) >= 20 and 4 <= len(sizes) <= 16
    again = graph.cell_components(out, "region")
    assert again.select("component").distinct().count() == len(sizes)  # each region is connected
    assert segment.require_mean_size(out.withColumn("region", F.col("region") + 1), "region", 20) >= 20
    with pytest.raises(ValueError):
        segment.require_mean_size(out.withColumn("region", F.col("region") + 1), "region", 2000)


def test_mean_shift_does_not_see_tiles(spark):
    a = np.random.default_rng(2).random((40, 40)) * 30
    one, many = (segment.mean_shift(cells(spark, a, "b"), ["b"], 1, 8.0, 0.1, 100, tile) for tile in (64, 16))
    assert np.allclose(to_array(one, "b", a.shape), to_array(many, "b", a.shape))


def test_window_textures(spark):
    grid = np.random.default_rng(1).integers(0, 4, (6, 7))
    out = {(r["r"], r["c"]): r for r in texture.window_textures(cells(spark, grid, "q"), "q").collect()}
    p = np.zeros((4, 4))
    for r in (2, 3):
        for c in (2, 3):
            p[grid[r, c], grid[r + 1, c + 1]] += 1
            p[grid[r + 1, c + 1], grid[r, c]] += 1
    p /= p.sum()
    i, j = np.indices(p.shape)
    row = out[3, 3]
    assert np.isclose(row["energy"], (p**2).sum()) and np.isclose(row["inertia"], (p * (i - j) ** 2).sum())
    assert np.isclose(row["entropy"], -(p[p > 0] * np.log(p[p > 0])).sum())
    mean = (p * i).sum()
    assert np.isclose(row["clushade"], (p * (i + j - 2 * mean) ** 3).sum())
    assert np.isclose(row["correlation"], ((p * i * j).sum() - mean**2) / ((p * i * i).sum() - mean**2))
    margins = np.concatenate([p.sum(axis=1), np.zeros(4)])
    assert np.isclose(row["hcorr"], ((p * i * j).sum() - margins.mean() ** 2) / margins.var())


def test_curation_report(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "class int")
    b = spark.createDataFrame([(1,), (3,)], "class int")
    assert {tuple(r) for r in curate.report(a, b, "class").collect()} == {(1, 2, 1), (2, 1, 0), (3, 0, 1)}


def test_overlay(spark):
    grid = cells(spark, np.zeros((40, 40), dtype=int), "x").select("r", "c")
    boxes = spark.createDataFrame([(1, 5, 0, 35, 0, 35), (2, 6, 30, 39, 30, 39)], "ord int, id int, r0 int, r1 int, c0 int, c1 int")
    burnt = overlay.burn_boxes(grid, boxes, "id")
    counts = {r["id"]: r["n"] for r in vote.class_counts(burnt, "id").collect()}
    assert counts == {5: 36 * 36 - 36, 6: 100, 0: 1600 - 1360}
    left = overlay.subtract_cells(grid, burnt.where("id = 6"))
    assert left.count() == 1500 and overlay.intersect_cells(left, burnt.where("id = 5")).count() == 1260
    ring = overlay.burn_rings(grid, [(3, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "id")
    assert ring.where("id = 3").count() == 100


def test_paint_conserves_cells(spark):
    grid = cells(spark, np.array([[1, 1, 2], [2, 3, 3]]), "seg")
    table = spark.createDataFrame([(1, 5), (2, 10)], "seg int, class int")
    for limit in (100, 0):
        painted = paint.paint(grid, table, "seg", "class", broadcast_rows=limit)
        dist = {r["final_id"]: r for r in paint.distribution(painted, "class", F.lit(True)).collect()}
        assert {k: (r["name"], r["n_pixels"]) for k, r in dist.items()} == {5: ("Natural Forest", 2), 10: ("id_10", 2), 0: ("id_0", 2)}
        assert math.isclose(sum(r["pct_aoi"] for r in dist.values()), 100)


def test_hierarchy(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, 0.9), (2, 5, 5.0, 0.9), (3, 5, 5.0, 0.9), (4, 6, 5.0, 0.6), (5, 6, 10.0, 0.7), (6, 8, 5.0, 0.9)], "seg int, l1 int, canopy double, green double")
    level2 = spark.createDataFrame([(2, 7)], "seg int, final_id int")
    get = lambda *a: {r["seg"]: r["final_class"] for r in model.hierarchy(rows, "l1", *a).collect()}
    assert get(None, "seg") == {1: 1, 2: 5, 3: 5, 4: 8, 5: 8, 6: 0}
    assert get(level2, "seg") == {1: 1, 2: 7, 3: 5, 4: 8, 5: 8, 6: 0}
    assert get(level2, "seg", model.Regrowth(apply=True)) == {1: 1, 2: 10, 3: 5, 4: 8, 5: 10, 6: 0}


def test_forest(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, float(x + 5 * (i % 3)), float(rng.random()), i % 3 + 1) for i, x in enumerate(rng.random(240))]
    table = spark.createDataFrame(rows + [(999, None, 1.0, 1)], "pid int, a double, b double, class int")
    train, test = model.split(table, "pid")
    assert train.count() + test.count() == 241 and 120 < train.count() < 200
    forest = model.Forest(trees=5, depth=4)
    fitted = model.fit(train, ["a", "b"], "class", forest)
    _, scores, per = model.evaluate(fitted, test, ["a", "b"], "class", [1, 2, 3])
    assert scores.first()["accuracy"] > 0.9 and per.count() == 3
    ranked = model.importances(fitted, ["a", "b"])
    assert evaluate.top_features(ranked, 1).first()["feature"] == "a"
    fitted.write().overwrite().save(f"{tmp_path}/forest")
    again = PipelineModel.load(f"{tmp_path}/forest")
    key = lambda m: sorted((r["pid"], r["predicted"]) for r in model.predict(m, test, ["a", "b"]).collect())
    assert key(again) == key(fitted)
    _, kept = model.top_n_retrain(train, ranked, 1, "class", forest)
    assert kept == ["a"]
    folds = model.cross_validate(table, "pid", ["a"], "class", [1, 2, 3], folds=3, forest=forest)
    rows = folds.collect()
    assert [r["fold"] for r in rows] == [0, 1, 2] and sum(r["test_size"] for r in rows) == 241
    assert evaluate.fold_summary(folds).first()["cv_accuracy_mean"] > 0.9
    model.require_rows(table)
    with pytest.raises(ValueError):
        model.require_rows(table.limit(11))


def _noise(spark, n: int):
    rng = np.random.default_rng(1)
    features = [f"f{i}" for i in range(9)]
    rows = [(i, *map(float, x), int(k)) for i, (x, k) in enumerate(zip(rng.random((n, 9)), rng.integers(0, 4, n), strict=True))]
    return spark.createDataFrame(rows, f"pid int, {', '.join(f'{x} double' for x in features)}, class int"), features


@pytest.mark.parametrize("local, chunk", [(2_000_000, 1 << 25), (200, 4096)])
def test_forest_grows_whole_trees(spark, monkeypatch, local, chunk):
    """Deep trees that hold all rows know each of them, whether grown in one task, or from histograms and pieces and read in parts."""
    monkeypatch.setattr(forest, "LOCAL", local)
    monkeypatch.setattr(forest, "HISTOGRAMS", local * 128)
    monkeypatch.setattr(forest, "CHUNK", chunk)
    rows, features = _noise(spark, 120)
    rows = rows.repartition(3).unionByName(spark.createDataFrame([(999, *[None] * 9, 1)], rows.schema))
    fitted = model.fit(rows, features, "class", model.Forest(trees=4, sample=20.0))
    trees = fitted.stages[0].trees
    assert trees.where("piece = -1").count() == 4
    pieces = trees.where("piece >= 0").count()
    assert pieces == 4 if local > 10_000 else pieces > 4
    got = model.predict(fitted, rows, features).select("pid", "class", "predicted").collect()
    assert sorted(r["pid"] for r in got) == list(range(120)) and all(r["class"] == r["predicted"] for r in got)
    assert abs(sum(fitted.stages[0].importances()) - 1) < 1e-9
    again = model.fit(rows, features, "class", model.Forest(trees=4, sample=20.0, depth=2))
    assert max(len(bytes(r["feature"])) for r in again.stages[0].trees.collect()) <= 4 * 7


def test_forest_split_is_the_best(spark):
    """The first split of a tree of all features is that of the least gini of all cuts, by brute force."""
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 6, (80, 3)).astype(np.uint8), rng.integers(0, 3, 80), rng.integers(1, 4, 80)
    counts = np.bincount(y, w, 3)[None]
    node = np.zeros(80, dtype=np.int64)
    feature, cut, score, left = forest._search(x, y, w, node, counts, np.array([[0, 1, 2]]), 5, 6)
    best = -1.0
    for f in range(3):
        for c in range(5):
            sides = [np.bincount(y[side], w[side], 3) for side in (x[:, f] <= c, x[:, f] > c)]
            if min(s.sum() for s in sides) >= 5:
                best = max(best, sum((s**2).sum() / s.sum() for s in sides))
    assert abs(best - score[0]) < 1e-9
    assert (left[0] == np.bincount(y[x[:, feature[0]] <= cut[0]], w[x[:, feature[0]] <= cut[0]], 3)).all()


def test_forest_of_defaults_is_fast(spark):
    """Deep trees of labels without a pattern: level by level over all rows this took many passes for each tree."""
    rows, features = _noise(spark, 12_000)
    began = time.time()
    fitted = model.fit(rows, features, "class")
    assert model.predict(fitted, rows, features).where("class = predicted").count() > 9_000
    assert time.time() - began < 90


def test_radar(spark):
    df = spark.createDataFrame([(1, "2020-12-31 00:00:00", 1.0), (1, "2020-06-01 00:00:00", 3.0), (2, "2019-04-01 00:00:00", 5.0)], "pixel int, ts string, vv double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = {r["pixel"]: r for r in radar.seasonal_means(df, ["vv"]).collect()}
    assert tuple(rows[1])[1:] == (1.0, 3.0, -2.0) and tuple(rows[2])[1:] == (None, 5.0, None)
    assert radar.newest_year(df, range(2017, 2025)) == 2020
    assert radar.between_dates(df, "2020-06-01", "2020-12-31").count() == 1
    assert {r["pixel"]: r["vv"] for r in radar.mosaic(df, ["vv"], []).collect()} == {1: 1.0, 2: 5.0}
    with pytest.raises(ValueError):
        radar.newest_year(df, range(1990, 1995))


def _tiff(array, tile=None, deflate=False, more=()):
    """A little-endian TIFF of float32 bands, interleaved by pixel, in strips of 3 rows or square tiles.

    more: further tags as (tag, type, number of values, bytes).
    """
    h, w, n = array.shape
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                block = np.zeros((tile, tile, n), dtype="<f4")
                part = array[r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block.tobytes())
    else:
        blocks = [array[r : r + 3].astype("<f4").tobytes() for r in range(0, h, 3)]
    if deflate:
        blocks = [zlib.compress(b) for b in blocks]
    tags = {256: [w], 257: [h], 258: [32], 259: [8 if deflate else 1], 277: [n], 339: [3]}
    tags |= {322: [tile], 323: [tile], 324: None, 325: [len(b) for b in blocks]} if tile else {278: [3], 273: None, 279: [len(b) for b in blocks]}
    body, at = b"", 8
    offsets = []
    for b in blocks:
        offsets.append(at + len(body))
        body += b
    tags[324 if tile else 273] = offsets
    entries, extra, extra_at = b"", b"", 8 + len(body) + 2 + 12 * (len(tags) + len(more)) + 4
    for tag, kind, count, packed in sorted([(t, 4, len(v), struct.pack(f"<{len(v)}I", *v)) for t, v in tags.items()] + list(more)):
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, kind, count, extra_at + len(extra))
            extra += packed
        else:
            entries += struct.pack("<HHI", tag, kind, count) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags) + len(more)) + entries + struct.pack("<I", 0) + extra


@pytest.mark.parametrize("tile,deflate", [(None, False), (None, True), (4, True)])
def test_geotiff(spark, tmp_path, tile, deflate):
    a = np.random.default_rng(3).random((10, 7, 2)).astype("<f4")
    a[2, 3, 1] = np.nan
    (tmp_path / "x.tif").write_bytes(_tiff(a, tile, deflate))
    wide = io.as_bands(io.read_geotiff(spark, f"{tmp_path}/x.tif", 2), 2)
    for k in (1, 2):
        assert np.array_equal(to_array(wide, f"b{k}", (10, 7)), a[:, :, k - 1].astype(float), equal_nan=True)
    with pytest.raises(Exception, match="3 are needed"):
        io.read_geotiff(spark, f"{tmp_path}/x.tif", 3).collect()


def test_geotiff_windows_and_downloads(spark, tmp_path):
    a = np.random.default_rng(3).random((10, 7, 2)).astype("<f4")
    a[4, 5, 0] = -99.0
    more = [(33550, 12, 3, struct.pack("<3d", 3.0, 2.0, 0.0)), (33922, 12, 6, struct.pack("<6d", 0, 0, 0, 500.0, 900.0, 0)), (34735, 3, 8, struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32748)), (42113, 2, 4, b"-99\0")]
    (tmp_path / "x.tif").write_bytes(_tiff(a, 4, True, more))
    head = io.geotiff_headers(spark, f"{tmp_path}/x.tif").first()
    assert tuple(head)[1:] == (10, 7, 2, 500.0, 900.0, 3.0, 2.0, 32748, -99.0, 4, 4, 6)
    want = np.where(a[:, :, 0] == -99, np.nan, a[:, :, 0].astype(float))
    for rows in (io.read_geotiff(spark, f"{tmp_path}/x.tif", 1), io.read_geotiff_windows(spark, f"{tmp_path}/x.tif", 1, blocks=2)):
        assert np.array_equal(to_array(rows, "value", (10, 7)), want, equal_nan=True)
    part = io.read_geotiff_windows(spark, f"{tmp_path}/x.tif", 2, blocks=1, window=(1, 3, 2, 5))
    assert part.count() == 3 * 4 * 2
    with zipfile.ZipFile(tmp_path / "download", "w") as z:
        for k in (1, 0):
            z.writestr(f"band{k}.tif", _tiff(a[:, :, k : k + 1]))
    wide = io.as_bands(io.read_download(spark, f"{tmp_path}/download", 2), 2)
    assert np.array_equal(to_array(wide, "b2", (10, 7)), a[:, :, 1].astype(float))
    assert io.read_download(spark, f"{tmp_path}/x.tif", 2).count() == 140
    (tmp_path / "page").write_bytes(b"<html>")
    with pytest.raises(Exception, match="neither"):
        io.read_download(spark, f"{tmp_path}/page", 1).collect()


def test_reference_grid(spark):
    a = np.arange(48.0).reshape(6, 8)
    source = cells_of.Grid(100.0, 60.0, 10.0, 10.0, 6, 8)
    same = cells_of.to_reference(cells(spark, a), source, source, "v")
    assert np.array_equal(to_array(same, "v", a.shape), a)
    finer = cells_of.Grid(110.0, 50.0, 5.0, 5.0, 4, 4)
    got = to_array(cells_of.to_reference(cells(spark, a), source, finer, "v"), "v", (4, 4))
    r, c = np.indices((4, 4)) * 0.5 + 0.75
    assert np.allclose(got, r * 8 + c)  # the values are a plane
    near = to_array(cells_of.to_reference(cells(spark, a), source, finer, "v", nearest=True), "v", (4, 4))
    assert np.array_equal(near, np.kron(a[1:3, 1:3], np.ones((2, 2))))
    beyond = cells_of.Grid(0.0, 60.0, 10.0, 10.0, 6, 12)
    assert cells_of.to_reference(cells(spark, a), source, beyond, "v").count() == 12


def _wkb(*polygons):
    """A multipolygon, big-endian members and all."""
    out = struct.pack("<BII", 1, 6, len(polygons))
    for order, rings in zip("><" * len(polygons), polygons):
        out += struct.pack(f"{order}BII", order == "<", 3, len(rings))
        for ring in rings:
            out += struct.pack(f"{order}I", len(ring)) + b"".join(struct.pack(f"{order}2d", *p) for p in ring)
    return out


def test_polygons_with_holes(spark):
    grid = cells(spark, np.zeros((70, 70), dtype=int), "x").select("r", "c")
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    rows = [(1, 5, _wkb([box(0, 0, 60, 60), box(10, 10, 50, 50)], [box(64, 64, 70, 70)])), (2, 6, _wkb([box(5, 5, 20, 20)])), (3, 7, None)]
    polygons = io.with_edges(spark.createDataFrame(rows, "ord int, id int, g binary"), "g")
    burnt = overlay.burn_polygons(grid, polygons, "id")
    assert burnt.count() == 4900
    counts = {r["id"]: r["n"] for r in vote.class_counts(burnt, "id").collect()}
    ring = 3600 - 1600
    overlapped = 15 * 15 - 10 * 10  # of the later box, what lies on the first one and not in its hole
    assert counts[6] == 225 and counts[5] == ring + 36 - overlapped
    pairs = overlay.cells_in_polygons(grid, polygons)
    assert pairs.count() == ring + 36 + 225
    scaled = io.with_edges(spark.createDataFrame([(1, 4, _wkb([box(100, 40, 120, 60)]))], "ord int, id int, g binary"), "g", cells_of.Grid(100.0, 60.0, 2.0, 2.0, 70, 70))
    assert overlay.burn_polygons(grid, scaled, "id").where("id = 4 and r < 10 and c < 10").count() == 100
    with pytest.raises(Exception, match="only WKB"):
        io.with_edges(spark.createDataFrame([(struct.pack("<BI2d", 1, 1, 0, 0),)], "g binary"), "g").collect()


def test_percentiles_of_skewed_values(spark):
    """One value on a third of the rows, gaps, an empty column; positions between values and on them."""
    rng = np.random.default_rng(8)
    a = np.where(rng.random(3001) < 0.33, 5.0, rng.normal(size=3001).round(2))
    table = spark.createDataFrame([(float(x), None if i % 7 == 0 else float(x) * 2, None) for i, x in enumerate(a)], "a double, b double, c double").repartition(7)
    wanted = {f"{k}{q}": (k, q) for k in "abc" for q in (0.0, 0.02, 0.5, 0.977, 1.0)}
    got = percentiles(table, wanted).first().asDict()
    b = np.array([2 * x for i, x in enumerate(a) if i % 7])
    for name, (k, q) in wanted.items():
        assert got[name] is None if k == "c" else np.isclose(got[name], np.percentile(a if k == "a" else b, 100 * q)), name
    zones = spark.createDataFrame([(1 if i % 3 else 2 + i % 5, float(x)) for i, x in enumerate(a)], "seg int, v double").repartition(7)
    ranges = {r["seg"]: r["range"] for r in zonal.index_range(zones, "v").collect()}
    for seg in ranges:
        own = np.sort([x for i, x in enumerate(a) if (1 if i % 3 else 2 + i % 5) == seg])
        assert ranges[seg] == own[math.ceil(0.9 * (len(own) - 1))] - own[math.floor(0.1 * (len(own) - 1))]


def test_deviation_about_means_that_are_no_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(1 + i % 3, float(i * i % 17)) for i in range(200)] + [(1, None)], "seg int, v double")
    one = sorted(map(tuple, zonal.variation_and_deviation(rows, "v").collect()))
    monkeypatch.setattr(zonal, "BROADCAST_ZONES", 1)
    assert np.allclose(sorted(map(tuple, zonal.variation_and_deviation(rows, "v").collect())), one)


def test_focal_spread_of_large_values(spark):
    """Small spreads about large values, across tiles and far along a row."""
    rng = np.random.default_rng(3)
    a = 2e5 + rng.normal(size=(6, 3000)) * 0.6
    pad = np.pad(a, 2, mode="symmetric")
    stack = np.stack([pad[2 + dr : 8 + dr, 2 + dc : 3002 + dc] for dr, dc in focal.circle(2)])
    out = focal.focal_mean_std(cells(spark, a), "v", 2, tile=64)
    assert np.allclose(to_array(out, "mean", a.shape), stack.mean(axis=0), rtol=1e-12)
    assert np.allclose(to_array(out, "std", a.shape), stack.std(axis=0), rtol=1e-6)


@pytest.mark.parametrize("tile", [256, 4])
def test_terrain_across_tiles(spark, tile):
    a = np.random.default_rng(4).random((9, 11)) * 50
    pad = np.pad(a, 1, mode="edge")
    out = focal.terrain(cells(spark, a), "v", 2.0, tile)
    gy, gx = np.gradient(a, 2.0)
    nine = np.stack([pad[1 + i : 10 + i, 1 + j : 12 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for name, want in {"gx": gx, "gy": gy, "tpi": a - nine.mean(axis=0), "tri": np.abs(nine - a).sum(axis=0) / 8}.items():
        assert np.allclose(to_array(out, name, a.shape), want), name


def test_files(spark, tmp_path):
    grid = cells(spark, np.arange(6.0).reshape(2, 3))
    io.write_features(grid.withColumn("f", F.col("v")), f"{tmp_path}/cache", {"a": 1})
    [folder] = (tmp_path / "cache").iterdir()
    assert io.read_features(spark, str(folder), ["f"]).columns == ["r", "c", "f"]
    with pytest.raises(FileNotFoundError, match="missing"):
        io.read_features(spark, str(folder), ["f", "missing"])
    io.write_raster(grid.withColumn("k", F.col("v").cast("int")), f"{tmp_path}/map", "k")
    assert spark.read.parquet(f"{tmp_path}/map").where("tile_r = 0").count() == 6
    (tmp_path / "m.csv").write_text("a,class\n1.5,2\nNaN,3\n")
    assert [tuple(r) for r in io.read_matrix(spark, f"{tmp_path}/m.csv", ["a"]).collect()] == [(1.5, 2), (None, 3)]
    (tmp_path / "p.csv").write_text("pid,x,y,class\n1,0.5,1.5,4\n")
    assert io.read_points(spark, f"{tmp_path}/p.csv", "class").first()["class"] == 4
    with pytest.raises(KeyError):
        io.read_points(spark, str(folder), "class")
    io.write_report(grid, f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == 6
    ring = [(0.0, 1.0), (4.0, 1.0), (4.0, 3.0), (0.0, 1.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    boxes = io.boxes_of(spark.createDataFrame([(1, wkb), (2, None)], "id int, g binary"), "g")
    assert [tuple(r)[2:] for r in boxes.orderBy("id").collect()] == [(0.0, 1.0, 4.0, 3.0), (None,) * 4]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "value")
    (tmp_path / "in").mkdir()
    events.write.mode("append").parquet(f"{tmp_path}/in")
    late = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).selectExpr("ts", "-1L as user_id", "0D as value")
    query = follow(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/check", f"{tmp_path}/out", "user_id", "value")
    try:
        query.processAllAvailable()
        late.write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark past all windows
        query.processAllAvailable()
    finally:
        query.stop()
    key = lambda df: sorted((r["user_id"], r["start"], r["n"], round(r["mean"], 9)) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(epoch_aggregates(events, "user_id", "value"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(-1000, 1000))), min_size=1, max_size=40), st.randoms())
def test_zonal_does_not_depend_on_order_or_names(spark, rows, rng):
    make = lambda r: spark.createDataFrame([(a, None if b is None else float(b)) for a, b in r], "seg int, v double")
    get = lambda df: sorted((r["seg"], r["size"], r["v__mean"], None if r["v__std"] is None else round(r["v__std"], 6)) for r in zonal.zonal_mean_std(df, ["v"]).collect())
    shuffled = list(rows)
    rng.shuffle(shuffled)
    assert get(make(rows)) == get(make(shuffled).repartition(3))
    moved = [(a + 10 if a else 0, b) for a, b in rows]
    assert [(s - 10, *x) for s, *x in get(make(moved))] == [tuple(x) for x in get(make(rows))]
