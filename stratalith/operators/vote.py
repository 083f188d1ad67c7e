"""Votes: labels of segments from points, overlays and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plurality(votes: DataFrame, segment: str, label: str) -> DataFrame:
    """``segment, label, n``: the commonest label of each segment; segments with a tie at the top drop out.

    Counts come first, so a segment with any number of votes has one row a label in the window.
    """
    counts = votes.groupBy(segment, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(segment).orderBy(F.desc("n"), label)
    ranked = counts.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.lead("n").over(w))
    return ranked.where((F.col("_rank") == 1) & (F.col("n") > F.coalesce("_next", F.lit(0)))).select(segment, label, "n")


def plurality_within(votes: DataFrame, segment: str, parent: Column, name: Column, names: dict[str, int], out: str) -> DataFrame:
    """The vote on a named subtype among the votes of its parent class. Unknown names are dropped."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    mapped = votes.where(parent & name.isNotNull()).withColumn(out, F.try_element_at(table, F.trim(name)))
    return plurality(mapped.where(F.col(out).isNotNull()), segment, out)


def unknown_names(votes: DataFrame, name: str, names: dict[str, int]) -> DataFrame:
    """The distinct names that the table does not have, for a warning."""
    return votes.select(F.trim(name).alias(name)).where(F.col(name).isNotNull()).distinct().where(~F.col(name).isin(*names))


def majority_with_default(overlay: DataFrame, segments: DataFrame, segment: str, label: str, default: int) -> DataFrame:
    """Each segment's commonest label above 0, ties to the least; segments without any get the default."""
    counts = overlay.where((F.col(segment) > 0) & (F.col(label) > 0)).groupBy(segment, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(segment).agg(F.max(F.struct("n", (-F.col(label)).alias("l"))).alias("b")).select(segment, (-F.col("b.l")).alias(label))
    return segments.join(best, segment, "left").withColumn(label, F.coalesce(label, F.lit(default)).cast("int"))


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))
