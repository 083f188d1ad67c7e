"""Evaluation of predictions and separability of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labels_table(spark, labels: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], "label int")


def confusion(pairs: DataFrame, labels: list[int]) -> DataFrame:
    """``y_true, y_pred, n`` for every pair of the given labels, zeros kept."""
    known = labels_table(pairs.sparkSession, labels)
    grid = known.select(F.col("label").alias("y_true")).crossJoin(known.select(F.col("label").alias("y_pred")))
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _margins(matrix: DataFrame) -> DataFrame:
    """``label, tp, actual, predicted``: a row for each label, from one pass over the small matrix."""
    ends = matrix.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    return ends.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))


def accuracy_kappa(matrix: DataFrame) -> DataFrame:
    """One row ``accuracy, kappa``. Kappa is null where chance agreement is 1."""
    total = _margins(matrix).agg(F.sum("tp").alias("tp"), F.sum("actual").alias("n"), F.sum(F.col("actual").cast("double") * F.col("predicted")).alias("e"))
    po, pe = F.try_divide(F.col("tp").cast("double"), F.col("n")), F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n"))
    return total.select(po.alias("accuracy"), F.try_divide(po - pe, 1.0 - pe).alias("kappa"))


def per_class(matrix: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support``: 0 where a denominator is 0."""
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    m = _margins(matrix).select("label", rate(F.col("tp"), F.col("predicted")).alias("precision"), rate(F.col("tp"), F.col("actual")).alias("recall"), F.col("actual").alias("support"))
    return m.select("label", "precision", "recall", rate(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation of the folds' accuracy and kappa."""
    return folds.agg(*(f(x).alias(f"cv_{x}_{n}") for x in ("accuracy", "kappa") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def melt(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``label, feature, x`` of wide rows."""
    return rows.unpivot([label], features, "feature", "x")


def class_signature(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``label, feature, mean, std``: sample deviation. Aggregated wide, melted after, so rows are not multiplied."""
    wide = rows.groupBy(label).agg(*(F.struct(F.avg(f).alias("mean"), F.stddev_samp(f).alias("std")).alias(f) for f in features))
    return wide.unpivot([label], features, "feature", "s").select(label, "feature", "s.mean", "s.std")


def separability(rows: DataFrame, label: str, features: list[str], floor: float = 1e-6) -> DataFrame:
    """``a, b, distance`` of all ordered pairs of classes: root of the sum of squared mean differences over variances.

    Deviations are of the population, plus a floor. The cross join is of one row a class.
    """
    stats = rows.groupBy(label).agg(*(F.struct(F.avg(f).alias("m"), (F.stddev_pop(f) + floor).alias("s")).alias(f) for f in features))
    a, b = stats.toDF("a", *(f"a_{f}" for f in features)), stats.toDF("b", *(f"b_{f}" for f in features))
    terms = F.lit(0.0)
    for f in features:
        d = F.col(f"a_{f}.m") - F.col(f"b_{f}.m")
        terms = terms + d * d / (F.col(f"a_{f}.s") * F.col(f"a_{f}.s") + F.col(f"b_{f}.s") * F.col(f"b_{f}.s"))
    return a.crossJoin(b).select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.sqrt(terms)).alias("distance"))


def isolation(distances: DataFrame) -> DataFrame:
    """``a, isolation, rank``: mean distance to the other classes, most isolated first, ties to the least class."""
    iso = distances.groupBy("a").agg((F.sum("distance") / (F.count("*") - 1)).alias("isolation"))
    return iso.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("isolation"), "a")))


def extreme_pairs(distances: DataFrame, closest: int = 6, farthest: int = 3) -> DataFrame:
    """``a, b, distance, kind``: the closest and the farthest unordered pairs."""
    pairs = distances.where("a < b")
    near = pairs.orderBy("distance", "a", "b").limit(closest).withColumn("kind", F.lit("closest"))
    far = pairs.orderBy(F.desc("distance"), "a", "b").limit(farthest).withColumn("kind", F.lit("farthest"))
    return near.unionByName(far)


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The k greatest importances with their rank, ties by name."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def seeded_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on a row's key and the seed alone, for splits that survive any reshuffle."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
