"""Feature names: how they are made, and which family and epoch a name belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The epochs in order with their days of the year, and the names of indices and statistics.
EPOCHS = ["march", "june", "aug", "sept", "jan25", "may25", "aug25", "sep25", "nov25", "mar26"]
DAYS = [81, 182, 218, 260, 10, 125, 227, 250, 328, 76]
LEGACY = ["NDVI", "NDWI", "NDBI", "EVI"]
EXTENDED = ["NDRE", "CIre", "RENDVI", "SAVI", "OSAVI", "MSAVI2", "GNDVI", "ARVI", "VARI", "BSI"]
TEMPORAL = ["NDVI", "EVI", "NDRE", "GNDVI"]
STATISTICS = ["max", "min", "std", "amp"]
PERCENTILES = ["p10", "p50", "p90"]
HARMONICS = ["harmAmp", "harmPhase", "harmOffset"]

# Families and the patterns of names without their statistic, tried in this order.
# SAVI comes before OSAVI and MSAVI2 and so takes their names too.
FAMILIES = [
    ("Haralick_NIR", "^har_NIR_"),
    ("Haralick_NDVI", "^har_NDVI_"),
    ("SAR_S1", "^S1_"),
    ("SAR_PALSAR", "^PALSAR_"),
    ("Meta_Canopy_v2", "^meta_canopy_"),
    ("Tree_Height", "tree_height"),
    ("Topography", "^(slope|aspect_sin|aspect_cos|tpi|tri)$"),
    ("Shape", "^(area_m2|perimeter_m|compactness|elongation|fill_ratio)$"),
    ("Texture", "^(entropyNDVI|entropyNIR|rangeNDVI|rangeNIR|cvNDVI|madNDVI)$"),
    ("Temporal_YoY", "^yoy"),
    ("Temporal_Harmonic", "^(harmAmp|harmPhase|harmOffset)"),
    ("Temporal_Percentiles", "^(p10|p50|p90)"),
    ("Temporal_MinMaxStd", "^(max|min|std|amp)[^a-z]*[A-Z][^a-z]*$"),
    *((f"{index}_Indices", index) for index in EXTENDED),
    ("NDVI_Indices", "NDVI"),
    ("NDBI_Indices", "NDBI"),
    ("NDWI_Indices", "NDWI"),
    ("EVI_Indices", "EVI"),
    ("Spectral_Bands", "_b[1-8]$"),
]
# The shorter list of the pixel classifier.
PIXEL_FAMILIES = [("Tree_Height", "tree_height"), ("NDVI_Indices", "NDVI"), ("NDBI_Indices", "NDBI"), ("NDWI_Indices", "NDWI"), ("EVI_Indices", "EVI"), ("Spectral_Bands", "_b[1-8]$")]


def legacy_names(epochs: list[str] = EPOCHS) -> list[str]:
    """Pixel features of the older cache: bands and legacy indices by epoch, their statistics, tree height."""
    names = [f"{e}_b{n}" for e in epochs for n in range(1, 9)] + [f"{e}_{i}" for e in epochs for i in LEGACY]
    return names + [f"{s}{i}" for i in LEGACY for s in STATISTICS] + ["tree_height_mean", "tree_height_std"]


def temporal_names(indices: list[str] = TEMPORAL) -> list[str]:
    return [f"{p}{i}" for i in indices for p in (*PERCENTILES, *HARMONICS)] + [f"yoy{i}_mar26_mar24" for i in indices]


def feature_names(epochs: list[str] = EPOCHS, temporal: bool = True) -> list[str]:
    """All pixel features of a stack. Ablations pass fewer epochs or leave the temporal ones out."""
    return legacy_names(epochs) + [f"{e}_{i}" for e in epochs for i in EXTENDED] + (temporal_names() if temporal else [])


def dictionary(spark: SparkSession, names: list[str]) -> DataFrame:
    """The dictionary table ``name`` from which families, epochs and columns are derived."""
    return spark.createDataFrame([(x,) for x in names], "name string")


def base_name(name: Column) -> Column:
    """A segment feature's name without its statistic."""
    return F.regexp_replace(name, "__(mean|std|seg)$", "")


def family(name: Column, rules: list[tuple[str, str]] = FAMILIES) -> Column:
    """The first family whose pattern a name has, else Other."""
    name, out = base_name(name), F
    for label, pattern in rules:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise("Other")


def epoch(name: Column, epochs: list[str] = EPOCHS) -> Column:
    """The epoch that a name begins with, the longest that fits; null for features of no one epoch."""
    name, out = base_name(name), F
    for e in sorted(epochs, key=lambda x: (-len(x), x)):
        out = out.when(name.startswith(f"{e}_"), e)
    return out


def group_importance(importance: DataFrame, group: Column, out: str) -> DataFrame:
    """Total, count and mean importance of each group of ``feature, importance``; rows without a group drop out."""
    grouped = importance.withColumn(out, group).where(F.col(out).isNotNull()).groupBy(out)
    return grouped.agg(F.sum("importance").alias("total_importance"), F.count("*").alias("feature_count"), F.avg("importance").alias("avg_importance"))
