"""Random forests: fit, evaluate, cross-validate, rank features, and the two-level class hierarchy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .evaluate import accuracy_kappa, confusion, per_class, seeded_uniform
from .forest import grow


# The defaults of the forest and of the regrowth rule.
@dataclass(frozen=True)
class Forest:
    """Parameters of the forest."""

    trees: int = 100
    depth: int = 30
    leaf: int = 1
    sample: float = 0.5
    bins: int = 128
    seed: int = 42


# Classes, the final classes, and how first-level classes and subtypes become final ones.
CLASSES = {1: "Waterbody", 2: "Paddy", 3: "Built-up", 4: "Others", 5: "Dense Vegetation", 6: "Sparse Vegetation", 7: "Crops"}
FINAL_CLASSES = {1: "Waterbody", 2: "Paddy", 3: "Built-up", 4: "Others", 5: "Natural Forest", 6: "Production Forest", 7: "Agroforest", 8: "Sparse Vegetation", 9: "Crops"}
REMAP = {1: 1, 2: 2, 3: 3, 4: 4, 6: 8, 7: 9}
SUBTYPES = {"Natural": 5, "Production": 6, "Agroforest": 7}
POLYGON_NAMES = {"Natural Forest": 5, "Production Forest": 6, "Agroforest": 7}
PARENT = 5


@dataclass(frozen=True)
class Regrowth:
    """The rule for young regrowth: eligible final classes with a canopy in a range and green above a limit."""

    apply: bool = False
    final_id: int = 10
    canopy: tuple[float, float] = (3.0, 10.0)
    green: float = 0.6
    eligible: tuple[int, ...] = (7, 8)
    columns: tuple[str, str] = field(default=("canopy", "green"))


def fit(rows: DataFrame, features: list[str], label: str, forest: Forest = Forest(), written: bool = False, like: PipelineModel | None = None) -> PipelineModel:
    """Rows with a gap in a feature or the label take no part. Predictions come as the label's own values. The model can be saved.

    written: features and label are plain columns of a written table, so it is read again and not copied. like: a model that
    was fitted with the same bins on the same rows, by these features and maybe more; its bins are taken.
    """
    # Else written first: it is read several times, and a filter on many computed columns is hard on the optimiser.
    scratch = Scratch(rows.sparkSession, "fit")
    kept = rows.select(*features, label) if written else scratch.keep(rows.select(*features, label), "rows")
    cuts = None if like is None else dict(zip(like.stages[0].features, like.stages[0].cuts, strict=True))
    fitted = grow(kept.na.drop(how="any", subset=[*features, label]).withColumn(label, F.col(label).cast("int")), features, label, forest, cuts and [cuts[f] for f in features])
    scratch.drop("rows")
    return PipelineModel([fitted])


def predict(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with ``predicted``; rows with a gap in a feature drop out."""
    return model.transform(rows.na.drop(how="any", subset=features))


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """``feature, importance`` of a fitted forest: one row for each feature of the plan."""
    weights = model.stages[0].importances()
    return SparkSession.active().createDataFrame(list(zip(features, weights, strict=True)), "feature string, importance double")


def split(rows: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by the hash of their key: the same whatever the partitions."""
    u = seeded_uniform(F.col(key), seed)
    return rows.where(u < share), rows.where(u >= share)


def evaluate(model: PipelineModel, rows: DataFrame, features: list[str], label: str, labels: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confusion matrix, accuracy and kappa, and per-class figures of a hold-out."""
    pairs = predict(model, rows, features).select(F.col(label).cast("int").alias("y_true"), F.col("predicted").alias("y_pred"))
    matrix = confusion(pairs, labels)
    return matrix, accuracy_kappa(matrix), per_class(matrix)


def cross_validate(rows: DataFrame, key: str, features: list[str], label: str, labels: list[int], folds: int = 5, forest: Forest = Forest()) -> DataFrame:
    """``fold, accuracy, kappa, train_size, test_size``; folds go by the hash of the key.

    The rows with their folds and each fold's scores are written, so no forest is fitted twice.
    """
    scratch = Scratch(rows.sparkSession, "folds")
    fold = F.floor(seeded_uniform(F.col(key), forest.seed) * folds).cast("int")
    dealt = scratch.keep(rows.withColumn("_fold", fold), "rows")
    out = None
    for k in range(folds):
        train, test = dealt.where(F.col("_fold") != k), dealt.where(F.col("_fold") == k)
        _, scores, _ = evaluate(fit(train, features, label, forest, written=True), test, features, label, labels)
        sizes = dealt.agg(F.count_if(F.col("_fold") != k).alias("train_size"), F.count_if(F.col("_fold") == k).alias("test_size"))
        row = scores.crossJoin(sizes).select(F.lit(k).alias("fold"), "accuracy", "kappa", "train_size", "test_size")
        row = scratch.keep(row, f"fold-{k}")
        out = row if out is None else out.unionByName(row)
    return out


def top_n_retrain(rows: DataFrame, ranked: DataFrame, n: int, label: str, forest: Forest = Forest(), written: bool = False, like: PipelineModel | None = None) -> tuple[PipelineModel, list[str]]:
    """A forest on the n most important features of ``feature, importance``; their names come to the driver. written, like: as for ``fit``."""
    names = [r["feature"] for r in ranked.orderBy(F.desc("importance"), "feature").limit(n).collect()]
    return fit(rows, names, label, forest, written, like), names


def require_rows(rows: DataFrame, least: int = 12) -> None:
    """The second level needs so many labelled segments."""
    n = rows.limit(least).count()
    if n < least:
        raise ValueError(f"{n} labelled segments; at least {least} are needed")


def hierarchy(segments: DataFrame, level1: str, level2: DataFrame | None, segment: str, rule: Regrowth = Regrowth()) -> DataFrame:
    """segments with ``final_class``: remapped first-level classes, subtypes for the parent class, then the rule.

    level2 is a table ``segment, final_id`` of overlays or predictions. Without it, and for parent
    segments that it lacks, the first subtype is the placeholder. Unknown classes are 0.
    """
    remap = F.create_map(*(F.lit(x) for kv in REMAP.items() for x in kv))
    out = segments if level2 is None else segments.join(level2.select(segment, F.col("final_id").alias("_l2")), segment, "left")
    subtype = F.lit(PARENT) if level2 is None else F.coalesce("_l2", F.lit(5))
    out = out.withColumn("final_class", F.when(F.col(level1) == PARENT, subtype).otherwise(F.coalesce(F.try_element_at(remap, F.col(level1)), F.lit(0))).cast("int"))
    if rule.apply:
        canopy, green = (F.col(c) for c in rule.columns)
        hit = F.col("final_class").isin(*rule.eligible) & canopy.between(*rule.canopy) & (green > rule.green)
        out = out.withColumn("final_class", F.when(hit, rule.final_id).otherwise(F.col("final_class")))
    return out.drop("_l2")
