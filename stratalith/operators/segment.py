"""Segmentation: mean-shift smoothing, components of like cells, and merging of small regions.

The segmentation is valid, not a copy of another implementation's: segments are connected, have at
least the least size where a neighbour exists, and do not depend on how labels are numbered.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .graph import cell_components, star_components

TILE = 256


#: How far a mode may be from its cell, in spatial radii.
TRAVEL = 3


def mean_shift(cells: DataFrame, bands: list[str], spatial_radius: int = 3, range_radius: float = 12.0, threshold: float = 0.1, rounds: int = 100, tile: int = TILE) -> DataFrame:
    """cells ``pid, r, c`` with each band moved to its mode.

    A step takes a cell's place and bands to the means of those cells within the spatial radius of the
    place whose bands lie within the range radius. A cell stops for itself, once no band moves by more
    than the threshold and its place by less than half a cell, and its place stays within TRAVEL radii.
    So what becomes of a cell follows from the cells up to ``(TRAVEL + 1) * spatial_radius`` away, which a
    tile carries as its halo, and tiles make no difference. A tile is the unit of a task; its size is fixed.
    """
    reach = TRAVEL * spatial_radius
    halo = reach + spatial_radius + 1
    span = lambda x: F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile))
    dealt = cells.select("pid", "r", "c", *(F.col(b).cast("double").alias(b) for b in bands)).withColumn("_tr", F.explode(span("r"))).withColumn("_tc", F.explode(span("c")))

    def shift(key, table):
        import numpy as np
        import pyarrow as pa

        tr, tc = (k.as_py() for k in key)
        r, c, pid = (table.column(k).to_numpy() for k in ("r", "c", "pid"))
        r0, c0 = tr * tile - halo, tc * tile - halo
        size = tile + 2 * halo
        start = np.full((len(bands), size, size), np.nan)
        for k, b in enumerate(bands):
            start[k, r - r0, c - c0] = table.column(b).to_numpy(zero_copy_only=False)
        own = np.flatnonzero((r >= tr * tile) & (r < (tr + 1) * tile) & (c >= tc * tile) & (c < (tc + 1) * tile))
        home = np.stack([r[own] - r0, c[own] - c0]).astype(np.float64)
        place, now = home.copy(), start[:, r[own] - r0, c[own] - c0]
        offsets = [(a, b) for a in range(-spatial_radius, spatial_radius + 1) for b in range(-spatial_radius, spatial_radius + 1)]
        active = np.flatnonzero(np.isfinite(now).all(axis=0))
        for _ in range(rounds):
            if not len(active):
                break
            centre, values = np.rint(place[:, active]).astype(np.int64), now[:, active]
            total, moved, count = np.zeros_like(values), np.zeros_like(centre, dtype=np.float64), np.zeros(len(active))
            for a, b in offsets:
                at = centre + np.array([[a], [b]])
                near = start[:, at[0], at[1]]
                like = ((near - values) ** 2).sum(axis=0) <= range_radius**2
                total += np.where(like, near, 0.0)
                moved += np.where(like, at, 0)
                count += like
            some = np.maximum(count, 1)
            values = np.where(count > 0, total / some, values)
            moved = np.clip(np.where(count > 0, moved / some, place[:, active]), home[:, active] - reach, home[:, active] + reach)
            on = (np.abs(values - now[:, active]).max(axis=0) > threshold) | (np.abs(moved - place[:, active]).max(axis=0) >= 0.5)
            now[:, active], place[:, active] = values, moved
            active = active[on]
        return pa.table({"pid": pid[own], "r": r[own], "c": c[own], **{b: now[k] for k, b in enumerate(bands)}})

    schema = "pid long, r int, c int, " + ", ".join(f"{b} double" for b in bands)
    return dealt.groupBy("_tr", "_tc").applyInArrow(shift, schema)


def like_components(cells: DataFrame, bands: list[str], step: float) -> DataFrame:
    """cells with ``component``: connected cells whose bands fall into the same steps."""
    mode = F.concat_ws("_", *(F.floor(F.col(b) / step).cast("string") for b in bands))
    return cells.join(cell_components(cells.withColumn("_mode", mode), "_mode").select("pid", "component"), "pid")


def _adjacency(cells: DataFrame, region: str) -> DataFrame:
    """``a, b`` of touching regions, both ways."""
    out = None
    for dr, dc in ((1, 0), (0, 1)):
        far = cells.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col(region).alias("b"))
        step = cells.select("r", "c", F.col(region).alias("a")).join(far, ["r", "c"]).where("a <> b").select("a", "b")
        out = step if out is None else out.union(step)
    return out.union(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def merge_small(cells: DataFrame, region: str, bands: list[str], least: int) -> DataFrame:
    """``pid, r, c, region``: regions under the least size join the touching region with the nearest mean bands.

    Each round all small regions choose at once, ties to the least region id, and chains of choices
    become one region. Rounds go on until no small region has a neighbour; each joins all that have one.
    """
    scratch = Scratch(cells.sparkSession, "merge")
    now = scratch.keep(cells.select("pid", "r", "c", *bands, F.col(region).alias("region")), "round-0")
    for turn in itertools.count(1):
        means = scratch.keep(now.groupBy("region").agg(F.count("*").alias("n"), *(F.avg(b).alias(b) for b in bands)), f"means-{turn}")
        small = means.where(F.col("n") < least)
        if small.isEmpty():
            break
        side = lambda k: means.select(F.col("region").alias(k), *(F.col(x).alias(f"_{k}_{x}") for x in bands))
        touch = _adjacency(now, "region").join(small.select(F.col("region").alias("a")), "a", "left_semi")
        near = touch.join(side("a"), "a").join(side("b"), "b")
        distance = sum(((F.col(f"_a_{x}") - F.col(f"_b_{x}")) * (F.col(f"_a_{x}") - F.col(f"_b_{x}")) for x in bands), F.lit(0.0))
        choice = near.groupBy("a").agg(F.min(F.struct(distance.alias("d"), "b")).alias("m")).select(F.col("a").alias("u"), F.col("m.b").alias("v"))
        choice = scratch.keep(choice, f"choice-{turn}")
        if choice.isEmpty():
            break
        roots = star_components(choice, Scratch(cells.sparkSession, "merge-stars"))
        named = now.join(roots, now["region"] == roots["node"], "left").select("pid", "r", "c", *bands, F.coalesce("root", "region").alias("region"))
        now = scratch.keep(named, f"round-{turn}")
        scratch.drop(f"round-{turn - 1}")
    return now.select("pid", "r", "c", "region")


def segment(cells: DataFrame, bands: list[str], spatial_radius: int = 3, range_radius: float = 12.0, least: int = 50) -> DataFrame:
    """The whole chain: smooth, connect like cells, merge small regions."""
    smooth = mean_shift(cells, bands, spatial_radius, range_radius)
    connected = like_components(smooth, bands, range_radius)
    return merge_small(connected, "component", bands, least)


def require_mean_size(cells: DataFrame, label: str, least: float = 20.0) -> float:
    """Mean cells of a segment; fewer than the least is an error, as the segmentation has collapsed."""
    n, k = cells.where(F.col(label) > 0).agg(F.count("*"), F.count_distinct(label)).first()
    if not k or n / k < least:
        raise ValueError(f"{n} cells in {k} segments: fewer than {least} each")
    return n / k
