"""Statistics of the epochs of each pixel, on arrays: no shuffle, one row a pixel in and out.

A series is ``array<double>`` in epoch order, with null for a missing epoch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = 365.25


def series(rows: DataFrame, key: str, epoch: str, value: str, n: int, out: str) -> DataFrame:
    """Long rows (key, epoch, value) as one array of n entries for each key. Epochs outside 0..n-1 are ignored."""
    at = [F.max(F.when(F.col(epoch) == e, F.col(value))) for e in range(n)]
    return rows.groupBy(key).agg(F.array(*at).alias(out))


def valid(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def _fold(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), f)


def mean(x: Column) -> Column:
    v = valid(x)
    return F.try_divide(_fold(v, lambda a, y: a + y), F.size(v))


def std(x: Column) -> Column:
    """Population standard deviation of the valid epochs."""
    v, m = valid(x), mean(x)
    return F.sqrt(F.try_divide(_fold(v, lambda a, y: a + (y - m) * (y - m)), F.size(v)))


def statistics(x: Column) -> dict[str, Column]:
    """max, min, std and amplitude."""
    return {"max": F.array_max(x), "min": F.array_min(x), "std": std(x), "amp": F.array_max(x) - F.array_min(x)}


def percentile(x: Column, q: float) -> Column:
    """Linear percentile of the valid epochs; null if there are none."""
    v = F.array_sort(valid(x))
    at = F.lit(q) * (F.size(v) - 1)
    lo = F.floor(at)
    low, high = F.get(v, lo.cast("int")), F.get(v, F.ceil(at).cast("int"))
    return low + (high - low) * (at - lo)


def harmonic_matrix(days: list[int]) -> list[list[float]]:
    """The least-squares matrix (X'X)^-1 X' of offset, cosine and sine at the days of the year."""
    import numpy as np

    angle = 2 * math.pi * np.array(days, dtype=float) / YEAR
    x = np.stack([np.ones_like(angle), np.cos(angle), np.sin(angle)], axis=1)
    return (np.linalg.inv(x.T @ x) @ x.T).tolist()


def harmonic(x: Column, days: list[int]) -> dict[str, Column]:
    """offset, amp and phase of one yearly wave; missing epochs take the pixel's mean.

    One matrix serves all pixels, so each coefficient is a dot product with literals.
    """
    m = mean(x)
    beta = []
    for row in harmonic_matrix(days):
        terms = [F.coalesce(F.get(x, F.lit(i)), m) * F.lit(w) for i, w in enumerate(row)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        beta.append(total)
    offset, cosine, sine = beta
    return {"offset": offset, "amp": F.hypot(cosine, sine), "phase": F.atan2(sine, cosine)}


def change(x: Column, first: int, last: int) -> Column:
    """Value of one epoch less that of another, both by position."""
    return F.get(x, F.lit(last)) - F.get(x, F.lit(first))
