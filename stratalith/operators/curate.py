"""Curation of training points: clean and conflicting segments, one point for each clean one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split(points: DataFrame, segment: str, label: str) -> DataFrame:
    """points with ``n_points`` and ``n_classes`` of their segment; segment 0 drops out."""
    inside = points.where(F.col(segment) > 0)
    per = inside.groupBy(segment).agg(F.count("*").alias("n_points"), F.countDistinct(label).alias("n_classes"))
    return inside.join(per, segment)


def centroids(cells: DataFrame, segment: str) -> DataFrame:
    """Mean row and column of each segment."""
    return cells.where(F.col(segment) > 0).groupBy(segment).agg(F.avg("r").alias("cr"), F.avg("c").alias("cc"))


def nearest_to_centroid(points: DataFrame, centres: DataFrame, segment: str, key: str, keep: list[str], distance: Column) -> DataFrame:
    """One point of each segment: the least distance, ties to the least key."""
    measured = points.join(centres, segment).withColumn("_d", distance)
    first = F.min(F.struct("_d", key, *keep)).alias("_p")
    return measured.groupBy(segment).agg(first).select(segment, F.col(f"_p.{key}").alias(key), *(F.col(f"_p.{k}").alias(k) for k in keep))


def merge_reviewed(curated: DataFrame, reviewed: DataFrame, segment: str, label: str, key: str) -> DataFrame:
    """Reviewed points of segments that now have one class and are not curated yet: the first of each, added."""
    clean = split(reviewed, segment, label).where("n_classes = 1").drop("n_points", "n_classes")
    first = clean.withColumn("_rank", F.row_number().over(Window.partitionBy(segment).orderBy(key))).where("_rank = 1").drop("_rank")
    return curated.unionByName(first.join(curated.select(segment), segment, "left_anti").select(*curated.columns))


def report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Counts of each class before and after, 0 where a side has none."""
    a = before.groupBy(label).agg(F.count("*").alias("before"))
    b = after.groupBy(label).agg(F.count("*").alias("after_curation"))
    return a.join(b, label, "full").select(label, *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("before", "after_curation")))
