"""Spectral and radar indices as column expressions.

Bands are 1 coastal, 2 blue, 3 green I, 4 green, 5 yellow, 6 red, 7 red edge, 8 near infrared. The
four legacy indices read band 4 as red; the newer ones read band 6 as red and band 4 as green, so
GNDVI equals the legacy NDVI. Denominators carry EPS except where a formula has none; those give
null when they vanish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10

Bands = Callable[[int], Column]


def _ratio(a: Column, b: Column) -> Column:
    """Normalised difference of two columns."""
    return (a - b) / (a + b + F.lit(EPS))


def legacy_indices(b: Bands) -> dict[str, Column]:
    """NDVI, NDWI (blue against band 4), NDBI (pseudo short-wave) and EVI."""
    evi = F.try_divide(2.5 * (b(8) - b(4)), b(8) + 6.0 * b(4) - 7.5 * b(2) + 1.0)
    return {"NDVI": _ratio(b(8), b(4)), "NDWI": _ratio(b(2), b(4)), "NDBI": _ratio(b(6), b(3)), "EVI": evi}


def extended_indices(b: Bands, soil: float = 0.5) -> dict[str, Column]:
    """The ten newer indices. ``soil`` is the soil factor of SAVI."""
    nir, red, green, blue, edge, yellow = b(8), b(6), b(4), b(2), b(7), b(5)
    atmosphere = 2.0 * red - blue
    inside = (2.0 * nir + 1.0) * (2.0 * nir + 1.0) - 8.0 * (nir - red)
    return {
        "NDRE": _ratio(nir, edge),
        "CIre": nir / (edge + F.lit(EPS)) - 1.0,
        "RENDVI": _ratio(edge, red),
        "SAVI": (nir - red) * (1.0 + soil) / (nir + red + F.lit(soil) + F.lit(EPS)),
        "OSAVI": (nir - red) / (nir + red + F.lit(0.16) + F.lit(EPS)),
        "MSAVI2": 0.5 * (2.0 * nir + 1.0 - F.sqrt(F.when(inside > 0, inside).when(inside <= 0, 0.0))),
        "GNDVI": _ratio(nir, green),
        "ARVI": (nir - atmosphere) / (nir + atmosphere + F.lit(EPS)),
        "VARI": (green - red) / (green + red - blue + F.lit(EPS)),
        "BSI": ((yellow + red) - (nir + blue)) / ((yellow + red) + (nir + blue) + F.lit(EPS)),
    }


def linear_to_db(x: Column) -> Column:
    """10 log10 of a linear backscatter, clamped from below at EPS. The input must be linear, not dB."""
    return F.when(x.isNotNull(), 10.0 * F.log10(F.greatest(x, F.lit(EPS))))


def digital_number_to_db(dn: Column, offset: float = 83.0) -> Column:
    """20 log10 of a digital number less an offset; no value where the number is not positive."""
    return F.when(dn > 0, 20.0 * F.log10(dn) - offset)


def radar_indices(co: Column, cross: Column) -> dict[str, Column]:
    """Ratio, radar vegetation index and the dual-polarisation index, all on dB values."""
    return {"ratio": co - cross, "RVI": F.try_divide(4.0 * cross, co + cross), "DPSVI": (cross + co) / 2.0}


def slope_aspect(gx: Column, gy: Column) -> dict[str, Column]:
    """Slope in degrees and the sine and cosine of aspect from the two gradients."""
    aspect = F.atan2(-gx, gy)
    return {"slope": F.degrees(F.atan(F.hypot(gx, gy))), "aspect_sin": F.sin(aspect), "aspect_cos": F.cos(aspect)}
