"""Connected components of cells.

Runs of cells along a row are one vertex from the start, so the graph has far fewer vertices than
cells. Large-star and small-star steps, each an aggregate and a join, shorten all paths to the least
vertex; tables in the shared checkpoint folder cut the lineage of every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges come with v < u: the neighbours of u that are smaller.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """``u, v`` in any order, repeats and loops allowed -> ``node, root`` of every vertex but the roots.

    The root is a component's smallest vertex. Vertices must not be null. rows is a bound of the number
    of edges, if one is known. Neither edges nor labels
    come to the driver; a vertex of any degree is one row a task in the aggregates, and the joins are
    of a form that adaptive execution can split.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, last = scratch.keep(edges, "edges-0", rows=rows), "edges-0"
    state, turn = _state(edges), 0
    while state[0]:
        turn += 1
        large = scratch.keep(_large_star(edges), f"large-{turn}", rows=2 * state[0])
        edges = scratch.keep(_small_star(large), f"edges-{turn}", rows=2 * state[0])
        scratch.drop(last, f"large-{turn}")
        last, before, state = f"edges-{turn}", state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def cell_components(cells: DataFrame, value: str | None = None) -> DataFrame:
    """cells ``pid, r, c`` (and the value) with ``component``, the least pid of the 4-connected component.

    With a value, only cells of equal value are neighbours.
    """
    scratch = Scratch(cells.sparkSession, "components")
    kept = ["pid", "r", "c"] + ([value] if value else [])
    row = Window.partitionBy("r").orderBy("c")
    joined = F.lag("c").over(row) == F.col("c") - 1
    if value:
        joined = joined & (F.lag(value).over(row) == F.col(value))
    numbered = cells.select(*kept, F.when(joined, 0).otherwise(1).alias("_new")).withColumn("_run", F.sum("_new").over(row))
    runs = scratch.keep(numbered.withColumn("run", F.min("pid").over(Window.partitionBy("r", "_run"))).select(*kept, "run"), "runs")
    above = runs.select((F.col("r") + 1).alias("r"), "c", F.col("run").alias("v"), *([value] if value else []))
    edges = runs.select("r", "c", F.col("run").alias("u"), *([value] if value else [])).join(above, ["r", "c"] + ([value] if value else []))
    roots = star_components(edges.select("u", "v"), scratch)
    # The least pid of a component is the least of its runs' names, as each is the least of its run.
    return runs.join(roots, runs["run"] == roots["node"], "left").select(*kept, F.coalesce("root", "run").alias("component"))
