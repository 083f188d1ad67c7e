"""Polygons on the grid: burning, intersection and difference as sets of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import percentiles


def burn_boxes(cells: DataFrame, shapes: DataFrame, value: str) -> DataFrame:
    """cells with the value of the last box (greatest ``ord``) whose inclusive rows r0..r1, columns c0..c1 hold them, else 0.

    Boxes are cut along the tiles of a 32-cell grid, so cells meet the boxes of their own tile in an
    equi-join and no pair of cell and far box is made.
    """
    tile = lambda x: F.floor(F.col(x) / 32).cast("int")
    cut = shapes.withColumn("_tr", F.explode(F.sequence(tile("r0"), tile("r1")))).withColumn("_tc", F.explode(F.sequence(tile("c0"), tile("c1"))))
    near = cells.withColumn("_tr", tile("r")).withColumn("_tc", tile("c")).join(cut, ["_tr", "_tc"])
    hits = near.where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    burnt = hits.groupBy("r", "c").agg(F.max(F.struct("ord", value)).alias("_b")).select("r", "c", F.col(f"_b.{value}").alias(value))
    return cells.join(burnt, ["r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a simple ring, by the parity of the edges that a ray to the right crosses."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            straddles = (F.lit(y0) > y) != (F.lit(y1) > y)
            at = F.lit(x0) + (y - y0) * ((x1 - x0) / (y1 - y0))
            crossings = crossings + F.when(straddles & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def burn_rings(cells: DataFrame, rings: list[tuple[int, list[tuple[float, float]]]], value: str) -> DataFrame:
    """cells with the value of the last ring that holds their centre, else 0. Rings are literals of the plan."""
    x, y, out = F.col("c") + 0.5, F.col("r") + 0.5, F.lit(0)
    for v, ring in rings:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
        out = F.when(box & in_ring(x, y, ring), v).otherwise(out)
    return cells.withColumn(value, out)


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, tile: int = 32) -> DataFrame:
    """The pairs of a cell and a polygon that holds its centre: cells' and polygons' columns.

    polygons have ``edges``, an array of (x0, y0, x1, y1) of all their rings in units of cells, as
    ``sources.io.with_edges`` gives. A centre lies inside if a ray to the right crosses an odd number of
    edges, so holes are outside. Polygons are cut along tiles, each with the edges alone that a ray from
    it can cross, and meet the cells of the tile in an equi-join; no polygon is a part of the plan.
    """
    index = lambda x: F.floor(x / tile).cast("int")
    # array_min and array_max over the edges bound a polygon without its rings being taken apart.
    bound = lambda f, a, b: f(F.array_union(F.transform("edges", lambda e: e[a]), F.transform("edges", lambda e: e[b])))
    boxed = polygons.where(F.size("edges") > 0).withColumns({"_x0": bound(F.array_min, "x0", "x1"), "_x1": bound(F.array_max, "x0", "x1"), "_y0": bound(F.array_min, "y0", "y1"), "_y1": bound(F.array_max, "y0", "y1")})
    cut = boxed.withColumn("_tr", F.explode(F.sequence(index(F.col("_y0")), index(F.col("_y1"))))).withColumn("_tc", F.explode(F.sequence(index(F.col("_x0")), index(F.col("_x1")))))
    top, bottom, left = F.col("_tr") * tile, (F.col("_tr") + 1) * tile, F.col("_tc") * tile
    near = cut.withColumn("_edges", F.filter("edges", lambda e: (F.greatest(e["y0"], e["y1"]) >= top) & (F.least(e["y0"], e["y1"]) <= bottom) & (F.greatest(e["x0"], e["x1"]) >= left)))
    pairs = cells.withColumn("_tr", index(F.col("r"))).withColumn("_tc", index(F.col("c"))).join(near.drop("edges", "_x0", "_x1", "_y0", "_y1"), ["_tr", "_tc"])
    x, y = F.col("c") + 0.5, F.col("r") + 0.5

    def crosses(e: Column) -> Column:
        return ((e["y0"] > y) != (e["y1"] > y)) & (x < e["x0"] + (y - e["y0"]) * ((e["x1"] - e["x0"]) / (e["y1"] - e["y0"])))

    odd = F.size(F.filter("_edges", lambda e: F.when(e["y0"] == e["y1"], F.lit(False)).otherwise(crosses(e)))) % 2 == 1
    return pairs.where(odd).drop("_tr", "_tc", "_edges")


def burn_polygons(cells: DataFrame, polygons: DataFrame, value: str) -> DataFrame:
    """cells with the value of the last polygon (greatest ``ord``) that holds their centre, else 0."""
    hits = cells_in_polygons(cells.select("r", "c"), polygons.select("ord", value, "edges"))
    burnt = hits.groupBy("r", "c").agg(F.max(F.struct("ord", value)).alias("_b")).select("r", "c", F.col(f"_b.{value}").alias(value))
    return cells.join(burnt, ["r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def intersect_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both with both's columns: the intersection of two sets of polygons."""
    return a.join(b, ["r", "c"])


def subtract_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a that b has not: what is left of a set of polygons."""
    return a.join(b, ["r", "c"], "left_anti")


def size_histogram(pieces: DataFrame, area: str, limits: list[float]) -> DataFrame:
    """``limit, n``: pieces of each limit's area or more, in one aggregate."""
    counts = pieces.agg(*(F.count_if(F.col(area) >= x).alias(f"_{i}") for i, x in enumerate(limits)))
    rows = F.array(*(F.struct(F.lit(float(x)).alias("limit"), F.col(f"_{i}").alias("n")) for i, x in enumerate(limits)))
    return counts.select(F.inline(rows))


def coverage(pieces: DataFrame, whole: DataFrame, area: str) -> DataFrame:
    """Percent of the whole's area that the pieces have, and their median area. Overlaps can exceed 100."""
    total = whole.agg(F.sum(area).alias("_total"))
    part = pieces.agg(F.sum(area).alias("_part")).crossJoin(F.broadcast(percentiles(pieces, {"median_area": (area, 0.5)})))
    return part.crossJoin(F.broadcast(total)).select(F.try_divide(100.0 * F.col("_part"), F.col("_total")).alias("coverage_pct"), "median_area")
