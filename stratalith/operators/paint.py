"""Painting segments' classes onto cells, and reports on the painted grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import FINAL_CLASSES


def paint(cells: DataFrame, table: DataFrame, segment: str, label: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """cells with the class of their segment, 0 where the segment has none.

    The table has one row a segment, far fewer than cells. It is broadcast only if it is counted to
    have no more than broadcast_rows rows; else the equi-join is left to the planner.
    """
    small = table.select(segment, label)
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        small = F.broadcast(small)
    return cells.join(small, segment, "left").withColumn(label, F.coalesce(label, F.lit(0)).cast("int"))


def class_name(label: Column, names: dict[int, str] = FINAL_CLASSES) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, label), F.concat(F.lit("id_"), label.cast("string")))


def distribution(cells: DataFrame, label: str, inside: Column) -> DataFrame:
    """``final_id, name, n_pixels, pct_aoi`` of the cells inside, class 0 with the others."""
    counts = cells.where(inside).groupBy(F.col(label).alias("final_id")).agg(F.count("*").alias("n_pixels"))
    total = counts.agg(F.sum("n_pixels").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("final_id", class_name(F.col("final_id")).alias("name"), "n_pixels", (100.0 * F.col("n_pixels") / F.col("_all")).alias("pct_aoi"))


def summary(cells: DataFrame, segments: DataFrame, counts: DataFrame, parameters: dict[str, float]) -> DataFrame:
    """One row ``summary``: a JSON object of sizes, class distribution and parameters."""
    sizes = segments.agg(F.count("*").alias("n_segments"))
    pixels = cells.agg(F.count("*").alias("n_pixels"))
    classes = counts.agg(F.sort_array(F.collect_list(F.struct("final_id", "name", "n_pixels", "pct_aoi"))).alias("classes"))
    fixed = F.struct(*(F.lit(v).alias(k) for k, v in parameters.items())).alias("parameters")
    return sizes.crossJoin(pixels).crossJoin(classes).select(F.to_json(F.struct("n_segments", "n_pixels", "classes", fixed)).alias("summary"))
