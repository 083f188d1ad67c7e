"""Cells of a shared grid: clipping, snapping of points, resampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A grid's upper left corner, the sizes of its cells, and its extent. Rows go down."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int


def centre(cells: DataFrame, grid: Grid) -> DataFrame:
    """cells with ``x, y``, the coordinates of their centres."""
    return cells.withColumns({"x": F.lit(grid.x0) + (F.col("c") + 0.5) * grid.dx, "y": F.lit(grid.y0) - (F.col("r") + 0.5) * grid.dy})


def to_reference(cells: DataFrame, source: Grid, reference: Grid, value: str, nearest: bool = False) -> DataFrame:
    """``r, c, value`` on a reference grid of the same coordinate system, bilinear or from the nearest cell.

    Each cell of the reference looks up the one or four source cells around its centre by an equi-join.
    Where its centre lies outside the source it has no row.
    """
    spark = cells.sparkSession
    n = F.lit(reference.cols)
    targets = spark.range(reference.rows * reference.cols).select(F.floor(F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    placed = centre(targets, reference).withColumns({"_r": (F.lit(source.y0) - F.col("y")) / source.dy - 0.5, "_c": (F.col("x") - source.x0) / source.dx - 0.5})
    placed = placed.where((F.col("_r") >= -0.5) & (F.col("_r") < source.rows - 0.5) & (F.col("_c") >= -0.5) & (F.col("_c") < source.cols - 0.5))
    if nearest:
        at = placed.select("r", "c", F.floor(F.col("_r") + 0.5).cast("int").alias("_sr"), F.floor(F.col("_c") + 0.5).cast("int").alias("_sc"))
        found = cells.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), value)
        return at.join(found, ["_sr", "_sc"]).select("r", "c", value)
    named = placed.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "_r", "_c")
    out = resample_bilinear(cells, named, F.col("_r"), F.col("_c"), value, F.lit(source.rows), source.cols)
    return out.select(F.col("tr").alias("r"), F.col("tc").alias("c"), value)


def clip(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int], row: str = "r", col: str = "c") -> DataFrame:
    """Cells of an inclusive box: a range predicate that reaches the scan."""
    return cells.where(F.col(row).between(*rows) & F.col(col).between(*cols))


def snap_floor(x: Column, origin: float, step: float, n: int) -> Column:
    """The cell that holds a coordinate; points beyond the grid go to its edge. A border belongs to the next cell."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor((x - origin) / step), F.lit(0)), F.lit(n - 1))).cast("int")


def snap_round(x: Column, origin: float, step: float, n: int) -> Column:
    """The nearest grid line, half to even, clipped: half a cell off ``snap_floor`` on grids of cell centres."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.rint((x - origin) / step), F.lit(0.0)), F.lit(float(n - 1)))).cast("int")


def sample_at_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points that carry ``r`` and ``c``, joined with the cells' columns. An equi-join, not a search."""
    return points.join(cells, ["r", "c"])


def resample_bilinear(cells: DataFrame, targets: DataFrame, row: Column, col: Column, value: str, n_rows: Column, n_cols: int) -> DataFrame:
    """``tr, tc, value`` at fractional source positions, from the four cells around each.

    row and col give a target's source position. Each target makes four rows of cell and weight,
    which meet the cells in an equi-join. Cells beyond the grid repeat its edge; missing cells drop
    out and the other weights are scaled up.
    """
    r0, c0 = F.floor(row), F.floor(col)
    fr, fc = row - r0, col - c0
    corner = lambda dr, dc, w: F.struct((r0 + dr).alias("r"), (c0 + dc).alias("c"), w.alias("w"))
    corners = F.explode(F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc)))
    around = targets.withColumn("_n", n_rows).select("tr", "tc", "_n", corners.alias("k")).where("k.w > 0")
    at = around.select("tr", "tc", F.least(F.greatest(F.col("k.r"), F.lit(0)), F.col("_n") - 1).cast("int").alias("r"), F.least(F.greatest(F.col("k.c"), F.lit(0)), F.lit(n_cols - 1)).cast("int").alias("c"), F.col("k.w").alias("w"))
    valid = F.when(F.col(value).isNotNull(), F.col("w"))
    return at.join(cells.select("r", "c", value), ["r", "c"]).groupBy("tr", "tc").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum(valid)).alias(value))


def resample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell as factor x factor finer ones: ``tr, tc`` beside its columns, without a join."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = cells.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.withColumn("tr", F.col("r") * factor + F.col("_i")).withColumn("tc", F.col("c") * factor + F.col("_j")).drop("_i", "_j")


def resample_average(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """``tr, tc, value``: the mean of the cells of each block; missing if one of them is."""
    out = cells.groupBy(F.floor(F.col("r") / factor).cast("int").alias("tr"), F.floor(F.col("c") / factor).cast("int").alias("tc"))
    return out.agg(F.when(F.count(value) == F.count("*"), F.avg(value)).alias(value))
