"""A Spark-native engine for raster stacks, segments and their classification.

Rasters on a shared grid are tables keyed by row and column; label rasters map cells to segments;
zonal, temporal, focal and model operators are DataFrame transformations that Catalyst plans.
"""
