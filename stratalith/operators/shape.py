"""Shape of segments from the label raster."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def perimeter_edges(cells: DataFrame, label: str) -> DataFrame:
    """``label, edges``: sides between cells of different labels. Each counts for both labels above 0.

    Sides on the border of the grid do not count, sides towards label 0 do.
    """
    pairs = []
    for along, across in (("c", "r"), ("r", "c")):
        w = Window.partitionBy(across).orderBy(along)
        step = cells.select(F.col(label).alias("a"), F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(label).over(w)).alias("b"))
        pairs.append(step.where("a <> b"))
    both = pairs[0].union(pairs[1]).select(F.explode(F.array("a", "b")).alias(label))
    return both.where(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("edges"))


def shape_features(cells: DataFrame, label: str, pixel_size: float) -> DataFrame:
    """Area, perimeter, compactness 4 pi A / P^2 (null for P = 0), elongation and fill of the bounding box."""
    inside = cells.where(F.col(label) > 0)
    box = inside.groupBy(label).agg(F.count("*").alias("_n"), (F.max("r") - F.min("r") + 1).alias("_h"), (F.max("c") - F.min("c") + 1).alias("_w"))
    joined = box.join(perimeter_edges(cells, label), label, "left")
    area, perimeter = F.col("_n") * float(pixel_size**2), F.coalesce("edges", F.lit(0)) * float(pixel_size)
    out = joined.select(label, area.alias("area_m2"), perimeter.alias("perimeter_m"), "_n", "_h", "_w")
    return out.select(
        label,
        "area_m2",
        "perimeter_m",
        F.when(F.col("perimeter_m") > 0, 4.0 * pi * F.col("area_m2") / (F.col("perimeter_m") * F.col("perimeter_m"))).alias("compactness"),
        (F.greatest("_h", "_w") / F.least("_h", "_w")).alias("elongation"),
        (F.col("_n") / (F.col("_h") * F.col("_w"))).alias("fill_ratio"),
    )
