"""Radar scenes ``pixel, ts, ...``: temporal, seasonal and newest-year composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months of the wet season, which runs over the turn of the year.
WET_MONTHS = (11, 12, 1, 2, 3)


def between_dates(scenes: DataFrame, start: str, end: str) -> DataFrame:
    """Scenes from start on and before end: predicates on the time stamp itself, which reach the scan."""
    return scenes.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def temporal_statistics(scenes: DataFrame, bands: list[str]) -> DataFrame:
    """mean, stdDev (population), min and max of each band for each pixel, and cv = |stdDev / mean|."""
    out = []
    for b in bands:
        out += [F.avg(b).alias(f"{b}_mean"), F.stddev_pop(b).alias(f"{b}_stdDev"), F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max")]
        out.append(F.abs(F.try_divide(F.stddev_pop(b), F.avg(b))).alias(f"{b}_CV"))
    return scenes.groupBy("pixel").agg(*out)


def seasonal_means(scenes: DataFrame, bands: list[str]) -> DataFrame:
    """wet, dry and wet - dry means of each band for each pixel, in one aggregate."""
    wet = F.month("ts").isin(*WET_MONTHS)
    out: list[Column] = []
    for b in bands:
        w, d = F.avg(F.when(wet, F.col(b))), F.avg(F.when(~wet, F.col(b)))
        out += [w.alias(f"{b}_wet"), d.alias(f"{b}_dry"), (w - d).alias(f"{b}_seasonal_diff")]
    return scenes.groupBy("pixel").agg(*out)


def newest_year(scenes: DataFrame, years: range) -> int:
    """The newest of the years that has a scene. One number comes to the driver; none found is an error."""
    found = scenes.where(F.year("ts").between(min(years), max(years))).agg(F.max(F.year("ts"))).first()[0]
    if found is None:
        raise ValueError(f"no scene from {min(years)} to {max(years)}")
    return found


def mosaic(scenes: DataFrame, bands: list[str], tie: list[Column]) -> DataFrame:
    """The last scene of each pixel wins; tie orders scenes of one time."""
    last = F.max(F.struct(F.col("ts"), *tie, *bands))
    return scenes.groupBy("pixel").agg(last.alias("_l")).select("pixel", *(F.col(f"_l.{b}").alias(b) for b in bands))
