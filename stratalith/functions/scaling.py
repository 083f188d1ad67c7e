"""Scaling of values: masks, stretches and quantisation against statistics of a whole table.

Statistics come from one aggregate row that is joined back. It is one row by construction, so its
broadcast does not grow with the data. Percentiles are exact and are found by ranges of values
(``operators.order``), without a task that holds a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import percentiles


def finite(x: Column) -> Column:
    """Null for a missing, NaN or infinite value: the form in which every operator expects gaps."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def mask_and_scale(x: Column, nodata: float, scale: float) -> Column:
    """Values from the sentinel upwards are missing; others are scaled."""
    return F.when(x < nodata, x * scale)


def clip_to_byte(x: Column) -> Column:
    """0 to 255; a missing value stays missing (greatest and least by themselves skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(255.0)), F.lit(0.0)))


def with_statistics(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with whole-table aggregates as columns; one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in aggregates.items()))))


def min_max(df: DataFrame, value: str, out: str, inside: Column) -> DataFrame:
    """Min-max normalisation by the cells inside; a range of 1e-12 or less counts as 1, outside is null."""
    x = F.when(inside, F.col(value))
    df = with_statistics(df, _lo=F.min(x), _hi=F.max(x))
    spread = F.col("_hi") - F.col("_lo")
    return df.withColumn(out, F.when(inside, (F.col(value) - F.col("_lo")) / F.when(spread <= 1e-12, F.lit(1.0)).otherwise(spread))).drop("_lo", "_hi")


def percentile_stretch(df: DataFrame, value: str, out: str, inside: Column, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """0 to 255 between two linear percentiles of the valid cells inside; 0 elsewhere."""
    x = F.when(inside, F.col(value))
    df = df.crossJoin(F.broadcast(percentiles(df, {"_lo": (x, low), "_hi": (x, high)})))
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    stretched = clip_to_byte((F.col(value) - F.col("_lo")) / spread * 255.0)
    return df.withColumn(out, F.when(inside & F.col(value).isNotNull(), stretched).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def byte_stretch(df: DataFrame, value: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The stretch truncated to whole bytes; missing values, and tables without any, give 0."""
    df = df.crossJoin(F.broadcast(percentiles(df, {"_lo": (value, low), "_hi": (value, high)})))
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    stretched = F.floor(clip_to_byte((F.col(value) - F.col("_lo")) / spread * 255.0))
    return df.withColumn(out, F.coalesce(stretched, F.lit(0)).cast("int")).drop("_lo", "_hi")


def quantise(df: DataFrame, value: str, out: str, levels: int = 32, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Levels 0 to levels - 1 between two percentiles, rounding half to even; 255 for missing values.

    Where the percentiles coincide the least and greatest values take their place.
    """
    df = with_statistics(df, _min=F.min(value), _max=F.max(value)).crossJoin(F.broadcast(percentiles(df, {"_a": (value, low), "_b": (value, high)})))
    flat = F.col("_b") <= F.col("_a")
    lo, hi = F.when(flat, F.col("_min")).otherwise(F.col("_a")), F.when(flat, F.col("_max")).otherwise(F.col("_b"))
    share = (F.col(value) - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    level = F.rint(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * float(levels - 1)).cast("int")
    return df.withColumn(out, F.when(F.col(value).isNull(), F.lit(255)).otherwise(level)).drop("_a", "_b", "_min", "_max")
