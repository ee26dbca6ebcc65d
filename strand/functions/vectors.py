"""Vector, graph-weight and score expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def time_decay(seconds: Column, span: Column, alpha: float) -> Column:
    """exp(-alpha |seconds| / span); 1 where all items have one time."""
    return F.when(span > 0, F.exp(-alpha * F.abs(seconds) / span)).otherwise(1.0)


def entity_distance(d: Column, shared: Column, path: Column, gamma: float, max_common: int, max_between: int) -> Column:
    """Distance weighted by shared entities, or by the passage-entity path where none is shared.

    No path counts as one of 2 * max_between steps.
    """
    near = 1 - (1 - d) * 0.5 * (1 + (1 - F.exp(-gamma * shared / max_common)))
    far = 1 - (1 - d) * 0.5 * F.exp(-gamma * (F.coalesce(path, F.lit(2 * max_between)) / 2) / max_between)
    return F.when(shared > 0, near).otherwise(far)


def prune_bound(alpha: float, threshold: float) -> float:
    """Share of the time span beyond which no pair can be under the threshold: cosine is at most 1."""
    return -math.log(1 - threshold) / alpha


def sigmoid(x: Column, clip: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def distance_bin(d: Column) -> Column:
    """Bins 0 to 4 by themselves, then 5-7, 8-15, 16-31, 32-63, 64 and over."""
    return F.when(d < 5, d).when(d < 8, 5).when(d < 16, 6).when(d < 32, 7).when(d < 64, 8).otherwise(9).cast("int")


def distance_share(d: Column) -> Column:
    return F.least(d, F.lit(64)) / F.lit(64.0)


def one_hot(x: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == x).cast("int"))


EARTH_KM = 6371.0


def great_circle_km(lat_1: Column, lon_1: Column, lat_2: Column, lon_2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat_2 - lat_1) / 2), 2) + F.cos(F.radians(lat_1)) * F.cos(F.radians(lat_2)) * F.pow(F.sin(F.radians(lon_2 - lon_1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def box_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Area of a bounding box: its height times its width along the southern edge."""
    return great_circle_km(south, west, north, west) * great_circle_km(south, west, south, east)


#: Weights of a place's position, frequency, entailment and precision (fixed values).
PLACE_WEIGHTS = (0.37, 0.3, 0.3, 0.03)
#: Weights of a date's position, likeness, entailment, distance to publication and duration (fixed values).
DATE_WEIGHTS = (0.24, 0.16, 0.0, 0.4, 0.2)


def weighted(weights: tuple[float, ...], *scores: Column) -> Column:
    total = F.lit(0.0)
    for w, s in zip(weights, scores, strict=True):
        total = total + w * s
    return total
