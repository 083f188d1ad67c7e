"""Zonal statistics: one row for each segment from the cells that it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import at_rank, percentiles, ranked, running_id

#: Aggregates in one pass that code generation still takes in; wider lists go in batches.
BATCH = 45

#: Parts over which a zone is spread where its mean comes by a shuffle.
SALT = 16


def _inside(cells: DataFrame, zone: str) -> DataFrame:
    return cells.where(F.col(zone) > 0)


def zonal_mean_std(cells: DataFrame, features: list[str], zone: str = "seg", std: bool = True) -> DataFrame:
    """``{feature}__mean`` and ``{feature}__std`` (population) of the valid cells, and ``size``.

    Zone 0 is outside. Zones without a valid cell of a feature have null there. One partial and one
    final aggregate for up to BATCH features; more are aggregated in batches on the same key, so the
    batches join where they lie.
    """
    out = None
    for at in range(0, max(1, len(features)), BATCH):
        part = features[at : at + BATCH]
        aggregates = [F.avg(x).alias(f"{x}__mean") for x in part] + [F.stddev_pop(x).alias(f"{x}__std") for x in part if std]
        size = [F.count("*").alias("size")] if out is None else []
        batch = _inside(cells, zone).groupBy(zone).agg(*size, *aggregates)
        out = batch if out is None else out.join(batch, zone)
    return out


def sizes(cells: DataFrame, zone: str = "seg") -> DataFrame:
    return _inside(cells, zone).groupBy(zone).agg(F.count("*").alias("size"))


def drop_slivers(segments: DataFrame, features: list[str], least: int = 4) -> DataFrame:
    """Segments of fewer cells keep their row and lose every feature."""
    return segments.withColumns({x: F.when(F.col("size") >= least, F.col(x)) for x in features})


def impute_median(segments: DataFrame, features: list[str], usable: Column) -> DataFrame:
    """Gaps of usable rows take the exact median of the usable rows. One row of medians is broadcast."""
    medians = percentiles(segments.where(usable), {f"_{x}": (x, 0.5) for x in features})
    out = segments.crossJoin(F.broadcast(medians))
    return out.withColumns({x: F.when(usable, F.coalesce(x, f"_{x}")).otherwise(F.col(x)) for x in features}).drop(*(f"_{x}" for x in features))


def entropy(cells: DataFrame, level: str, zone: str = "seg") -> DataFrame:
    """Entropy in nats of the levels of each zone: counts of (zone, level), then of zones. 255 is missing."""
    counts = _inside(cells, zone).where(F.col(level) != 255).groupBy(zone, level).agg(F.count("*").alias("n"))
    # -sum(p ln p) with p = n / N is ln N - sum(n ln n) / N: no window over the counts is needed.
    total = F.sum("n")
    return counts.groupBy(zone).agg((F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"))


def index_range(cells: DataFrame, value: str, zone: str = "seg", low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Sorted value at ceil(high (n - 1)) less that at floor(low (n - 1)), by position, not interpolated.

    Positions come from counts of a zone's values that are sorted by range, so a large zone is spread
    over tasks (``order.ranked``).
    """
    places = ranked(_inside(cells, zone).select(zone, value), [zone], value)
    last = F.col("total") - 1
    return places.groupBy(zone).agg((at_rank(value, F.ceil(high * last)) - at_rank(value, F.floor(low * last))).alias("range"))


#: Zones whose means are broadcast at most: two numbers and a key each, 64 MB in all.
BROADCAST_ZONES = 1 << 21


def variation_and_deviation(cells: DataFrame, value: str, zone: str = "seg") -> DataFrame:
    """``cv``: std by mean, null for means of 1e-6 or less; ``mad``: mean absolute deviation about the mean.

    The zones' means go to the cells by a broadcast if they are counted to be few enough. Else each
    mean is sent to SALT parts of its zone, so a zone with a third of the cells is no one task.
    """
    valid = _inside(cells, zone).where(F.col(value).isNotNull()).select(zone, value)
    means = valid.groupBy(zone).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    if means.limit(BROADCAST_ZONES + 1).count() <= BROADCAST_ZONES:
        centred = valid.join(F.broadcast(means), zone)
    else:
        salted = means.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        centred = valid.withColumn("_salt", F.pmod(F.hash(value), F.lit(SALT))).join(salted, [zone, "_salt"])
    mean, std = F.first("_m"), F.first("_s")
    return centred.groupBy(zone).agg(F.when(F.abs(mean) > 1e-6, std / mean).alias("cv"), F.avg(F.abs(F.col(value) - F.col("_m"))).alias("mad"))


def compact(cells: DataFrame, label: str, out: str = "segment_id") -> DataFrame:
    """Labels renumbered 1..n in order, with 0 kept as 0. The distinct labels alone are numbered."""
    ids = running_id(cells.where(F.col(label) != 0).select(label).distinct(), [label], out)
    return cells.join(ids, label, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))
