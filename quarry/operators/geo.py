"""Map geometry as Column math: equal-area projection on the ellipsoid, bounds of shapes, overlapping bounds by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Axis and flattening of the ellipsoid (fixed values: WGS 84).
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(sin: Column) -> Column:
    """The authalic function of a sine of latitude."""
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - F.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def project(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """struct(x, y) in metres: Lambert azimuthal equal-area around (lon0, lat0), angles in degrees."""
    pole = float((1 - _E2) * (1 / (1 - _E2) - math.log((1 - _E) / (1 + _E)) / (2 * _E)))
    s0 = math.sin(math.radians(lat0))
    q0 = (1 - _E2) * (s0 / (1 - _E2 * s0 * s0) - math.log((1 - _E * s0) / (1 + _E * s0)) / (2 * _E))
    b0, rq = math.asin(q0 / pole), AXIS * math.sqrt(pole / 2)
    d = AXIS * math.cos(math.radians(lat0)) / (math.sqrt(1 - _E2 * s0 * s0) * rq * math.cos(b0))
    beta, dl = F.asin(_q(F.sin(F.radians(lat))) / pole), F.radians(lon - lon0)
    b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(dl)))
    x, y = b * d * F.cos(beta) * F.sin(dl), b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(dl))
    return F.struct(x.alias("x"), y.alias("y"))


def bounds(points: DataFrame, key: str) -> DataFrame:
    """points(key, x, y) -> key, x0, y0, x1, y1."""
    return points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def overlapping(boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """Pairs of keys whose boxes overlap: boxes meet in the grid cells they cover, and each pair in its first common cell only."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("cx")).select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("cy"))
    a, b = (cells.select("cx", "cy", F.col(key).alias(f"{key}_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in ("x0", "y0", "x1", "y1")]) for e in "ab")
    meet = (F.col("x0_a") <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a")) & (F.col("y0_a") <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1_a"))
    first = (F.col("cx") == F.floor(F.greatest("x0_a", "x0_b") / cell)) & (F.col("cy") == F.floor(F.greatest("y0_a", "y0_b") / cell))
    pairs = a.join(b, ["cx", "cy"]).filter((F.col(f"{key}_a") < F.col(f"{key}_b")) & meet & first)
    return pairs.select(f"{key}_a", f"{key}_b")
