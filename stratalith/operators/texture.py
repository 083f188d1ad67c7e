"""Co-occurrence textures of quantised cells, by counting pairs.

A cell is paired with the one at an offset by a shifted equi-join; each pair is sent to the windows
that hold it, and textures are aggregates of the counts. Pairs go both ways (a symmetric matrix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The textures' names, in their order.
TEXTURES = ["energy", "entropy", "correlation", "idm", "inertia", "clushade", "cluprom", "hcorr"]

LEVELS = 8


def binned(byte: Column, levels: int = LEVELS) -> Column:
    """The level of a value from 0 to 255, in bins of equal width; a missing value has none."""
    return F.least(F.floor(byte * levels / 255.0), F.lit(levels - 1)).cast("int")


def pairs(cells: DataFrame, level: str, offset: tuple[int, int] = (1, 1)) -> DataFrame:
    """``r, c, i, j``: each cell's level and that of the cell at the offset, at the first cell's place."""
    dr, dc = offset
    far = cells.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col(level).alias("j"))
    return cells.select("r", "c", F.col(level).alias("i")).join(far, ["r", "c"])


def window_textures(cells: DataFrame, level: str, radius: int = 1, offset: tuple[int, int] = (1, 1), levels: int = LEVELS) -> DataFrame:
    """The eight textures over the window of each cell, from the pairs that lie in it with both cells.

    Sums are over p(i, j), symmetric. A window of one level has no variance: its correlation is null.
    ``hcorr`` is (sum of i j p(i, j) less m^2) by s^2, with the mean m and the variance s^2 of the
    marginal sums of p over all levels, 0 to levels - 1; it is null where these are all equal.
    """
    dr, dc = offset
    span = lambda a, d: F.sequence(F.col(a) + max(d, 0) - radius, F.col(a) + min(d, 0) + radius)
    sent = pairs(cells, level, offset).select("i", "j", F.explode(span("r", dr)).alias("r"), "c")
    sent = sent.select("i", "j", "r", F.explode(span("c", dc)).alias("c"))
    both = sent.select("r", "c", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"))
    counts = both.groupBy("r", "c", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count("*").cast("double").alias("n"))
    return _textures(counts, ["r", "c"], levels)


def zone_textures(cells: DataFrame, level: str, zone: str, offset: tuple[int, int] = (1, 1), levels: int = LEVELS) -> DataFrame:
    """The same textures over the pairs that start in each zone."""
    counted = pairs(cells, level, offset).join(cells.select("r", "c", zone), ["r", "c"]).groupBy(zone, "i", "j").agg(F.count("*").cast("double").alias("n"))
    mirrored = counted.unionByName(counted.select(zone, F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(zone, "i", "j").agg(F.sum("n").alias("n"))
    return _textures(mirrored, [zone], levels)


def _textures(counts: DataFrame, key: list[str], levels: int) -> DataFrame:
    """Aggregates of counts n of (i, j): by rows i for the marginal sums, then moments, from which all textures follow."""
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n")
    total = F.sum("n")
    d, s = i - j, i + j
    sums = {"n": total, "nn": F.sum(n * n), "nl": F.sum(n * F.log(n)), "i": F.sum(n * i), "ii": F.sum(n * i * i), "ij": F.sum(n * i * j), "dd": F.sum(n * d * d), "idm": F.sum(n / (1.0 + d * d)), "s": F.sum(n * s), "s2": F.sum(n * s * s), "s3": F.sum(n * s * s * s), "s4": F.sum(n * s * s * s * s)}
    rows = counts.groupBy(*key, "i").agg(*(v.alias(f"_{k}") for k, v in sums.items()))
    m = rows.groupBy(*key).agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums), F.sum(F.col("_n") * F.col("_n")).alias("_margins"))
    e = {k: F.col(f"_{k}") / F.col("_n") for k in sums if k != "n"}
    mean, variance = e["i"], e["ii"] - e["i"] * e["i"]
    centre = e["s"]
    shade = e["s3"] - 3.0 * centre * e["s2"] + 2.0 * centre * centre * centre
    prominence = e["s4"] - 4.0 * centre * e["s3"] + 6.0 * centre * centre * e["s2"] - 3.0 * centre * centre * centre * centre
    level = 1.0 / levels
    spread = F.col("_margins") / (F.col("_n") * F.col("_n")) * level - level * level
    return m.select(
        *key,
        (F.col("_nn") / (F.col("_n") * F.col("_n"))).alias("energy"),
        (F.log("_n") - e["nl"]).alias("entropy"),
        F.when(variance > 1e-12, (e["ij"] - mean * mean) / variance).alias("correlation"),
        e["idm"].alias("idm"),
        e["dd"].alias("inertia"),
        shade.alias("clushade"),
        prominence.alias("cluprom"),
        F.when(spread > 1e-12, (e["ij"] - level * level) / spread).alias("hcorr"),
    )
