"""Neighbourhood operators on cells ``r, c`` of a dense grid.

Sums and differences go by square tiles that carry a border of the kernel's reach: one shuffle by
tile, then windows along the rows and the columns of each tile. Votes go the other way: each cell
sends its label to the cells that it is a neighbour of, and partial aggregates run before the one
shuffle on the target. No task sees the whole grid.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def circle(radius: int) -> list[tuple[int, int]]:
    """Offsets with x^2 + y^2 <= radius^2."""
    span = range(-radius, radius + 1)
    return [(dr, dc) for dr in span for dc in span if dr * dr + dc * dc <= radius * radius]


#: Cells along a tile's side at least. A tile carries a border, so the share of cells that are sent twice is small.
TILE = 256


def _tiles(cells: DataFrame, halo: int, rows: Column, cols: Column, tile: int) -> DataFrame:
    """cells at places (``_r, _c``) of each tile ``_tr, _tc`` that needs them: its own and those up to ``halo`` beyond its sides.

    rows and cols are arrays of the places where a cell is seen from. This is the one shuffle.
    """
    span = lambda x: F.sequence(F.floor((x - halo) / tile), F.floor((x + halo) / tile))
    out = cells.withColumn("_r", F.explode(rows)).withColumn("_c", F.explode(cols))
    out = out.withColumn("_tr", F.explode(span(F.col("_r")))).withColumn("_tc", F.explode(span(F.col("_c"))))
    # Windows by tile and row, and then by tile and column, both lie in this partitioning.
    return out.repartition("_tr", "_tc")


def _own(tile: int) -> Column:
    return (F.floor(F.col("_r") / tile) == F.col("_tr")) & (F.floor(F.col("_c") / tile) == F.col("_tc"))


def _reflected(at: str, size: str, reach: int) -> Column:
    """The places of a cell up to ``reach`` beyond the grid: i is seen at -i - 1 and 2 size - 1 - i too, the edge repeated."""
    x, n = F.col(at).cast("long"), F.col(size)
    places = F.array(x, F.when(x < reach, -x - 1), F.when(x >= n - reach, 2 * n - 1 - x))
    return F.filter(places, lambda p: p.isNotNull())


def with_grid_size(cells: DataFrame, value: str) -> DataFrame:
    """cells with ``n_rows``, ``n_cols`` and ``mean``: one row of extents is broadcast."""
    return cells.crossJoin(F.broadcast(cells.agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"), F.avg(value).alias("_mean"))))


def focal_mean_std(cells: DataFrame, value: str, radius: int, tile: int = TILE) -> DataFrame:
    """``r, c, mean, std`` over a circle, edges reflected; std is sqrt(max(E[x^2] - E[x]^2, 0)).

    Every cell must have a value; ``tree_height`` fills gaps first. The grid is at least as wide and
    high as the radius.

    By tiles: along each row of a tile prefix sums give the sum over any run of columns, and along each
    column the runs of the kernel's rows add up. Values are taken less the grid's mean, and sums start
    anew with each tile, so squares do not drown the spread however wide the grid is.
    """
    tile = max(tile, 8 * radius)
    sized = with_grid_size(cells, value).select("r", "c", (F.col(value) - F.col("_mean")).alias("_v"), "_mean", "n_rows", "n_cols")
    padded = _tiles(sized, radius + 1, _reflected("r", "n_rows", radius), _reflected("c", "n_cols", radius), tile)
    row, col = Window.partitionBy("_tr", "_tc", "_r").orderBy("_c"), Window.partitionBy("_tr", "_tc", "_c").orderBy("_r")
    prefix = padded.withColumns({"_p": F.sum("_v").over(row), "_q": F.sum(F.col("_v") * F.col("_v")).over(row)})
    width = {dr: isqrt(radius * radius - dr * dr) for dr in range(-radius, radius + 1)}
    runs = {f"{name}{k}": F.lead(p, k).over(row) - F.coalesce(F.lag(p, k + 1).over(row), F.lit(0.0)) for k in sorted(set(width.values())) for name, p in (("_s", "_p"), ("_t", "_q"))}
    area = float(len(circle(radius)))
    total = {name: sum((F.lag(f"{name}{k}", -dr).over(col) for dr, k in width.items()), F.lit(0.0)) / area for name in ("_s", "_t")}
    out = prefix.withColumns(runs).withColumns(total).where(_own(tile) & F.col("_r").between(0, F.col("n_rows") - 1) & F.col("_c").between(0, F.col("n_cols") - 1))
    return out.select("r", "c", (F.col("_mean") + F.col("_s")).alias("mean"), F.sqrt(F.greatest(F.col("_t") - F.col("_s") * F.col("_s"), F.lit(0.0))).alias("std"))


def tree_height(cells: DataFrame, height: str, pixel_size: float, reach: float = 30.0) -> DataFrame:
    """Mean and std of height over a circle of ``reach`` metres; missing heights count as 0."""
    radius = max(1, round(reach / pixel_size))
    return focal_mean_std(cells.withColumn(height, F.coalesce(height, F.lit(0.0))), height, radius)


def focal_mode(cells: DataFrame, label: str) -> DataFrame:
    """``r, c, mode``: the commonest label above 0 of a cell and its four neighbours, ties to the least.

    A cell without any keeps its own; a cell of label 0 can take its neighbours'. No reflection:
    cells beyond the edge do not vote.
    """
    plus = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    sent = cells.where(F.col(label) > 0).select(label, F.explode(F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in plus))).alias("_t"))
    counts = sent.groupBy(F.col("_t.r").alias("r"), F.col("_t.c").alias("c"), label).agg(F.count("*").alias("n"))
    best = counts.groupBy("r", "c").agg(F.max(F.struct("n", (-F.col(label)).alias("l"))).alias("b")).select("r", "c", (-F.col("b.l")).alias("_mode"))
    return cells.join(best, ["r", "c"], "left").select("r", "c", F.coalesce("_mode", label).cast("int").alias("mode"))


def terrain(cells: DataFrame, height: str, pixel_size: float = 1.0, tile: int = TILE) -> DataFrame:
    """``r, c, gx, gy, tpi, tri``: central differences (one-sided at edges), height less the 3 x 3 mean, mean absolute step.

    Edges repeat. By tiles with a border of one cell: the neighbours to the left and right come from a
    window along a tile's rows, those above and below from one along its columns, after one shuffle.
    """
    placed = _tiles(cells.select("r", "c", F.col(height).alias("_z")), 1, F.array(F.col("r").cast("long")), F.array(F.col("c").cast("long")), tile)
    row, col = Window.partitionBy("_tr", "_tc", "_r").orderBy("_c"), Window.partitionBy("_tr", "_tc", "_c").orderBy("_r")
    sides = placed.withColumns({"_w": F.lag("_z").over(row), "_e": F.lead("_z").over(row)})
    sides = sides.withColumns({"_edge": F.col("_w").isNull() | F.col("_e").isNull(), "_w": F.coalesce("_w", "_z"), "_e": F.coalesce("_e", "_z")})
    beyond = {f"{k}{i}": f(k).over(col) for k in ("_z", "_w", "_e") for i, f in ((0, F.lag), (2, F.lead))}
    # Rows 0, 1 and 2 are the one above, the cell's own, and the one below.
    nine = sides.withColumns(beyond).where(_own(tile)).withColumn("_end", F.col("_z0").isNull() | F.col("_z2").isNull())
    nine = nine.withColumns({f"{k}{i}": F.coalesce(f"{k}{i}", k) for k in ("_z", "_w", "_e") for i in (0, 2)})
    here = F.col("_z")

    def gradient(before: str, after: str, edge: str) -> Column:
        return (F.col(after) - F.col(before)) / (F.when(F.col(edge), F.lit(1.0)).otherwise(F.lit(2.0)) * pixel_size)

    total, steps = here, F.lit(0.0)
    for k in ("_w0", "_z0", "_e0", "_w", "_e", "_w2", "_z2", "_e2"):
        total, steps = total + F.col(k), steps + F.abs(here - F.col(k))
    return nine.select("r", "c", gradient("_w", "_e", "_edge").alias("gx"), gradient("_z0", "_z2", "_end").alias("gy"), (here - total / 9.0).alias("tpi"), (steps / 8.0).alias("tri"))
