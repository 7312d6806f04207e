"""Distances and geometry as column expressions (WGS84 values are fixed)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis in km, flattening, radius of the spherical Mercator in m.
AXIS_KM, FLATTENING, MERCATOR_M = 6378.137, 1 / 298.257223563, 6378137.0
#: The least and the greatest radius of curvature of the surface.
LEAST_CURVATURE_KM, MOST_CURVATURE_KM = AXIS_KM * (1 - FLATTENING) ** 2, AXIS_KM / (1 - FLATTENING)


def ecef(latitude: Column, longitude: Column, depth_km: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in km of a point below the ellipsoid."""
    minor = AXIS_KM * (1 - FLATTENING)
    phi, lam = F.radians(latitude), F.radians(longitude)
    d = F.sqrt(AXIS_KM**2 * F.pow(F.cos(phi), 2) + minor**2 * F.pow(F.sin(phi), 2))
    flat = (AXIS_KM**2 / d - depth_km) * F.cos(phi)
    return flat * F.cos(lam), flat * F.sin(lam), (minor**2 / d - depth_km) * F.sin(phi)


def straight_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def mercator(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    return MERCATOR_M * F.radians(longitude), MERCATOR_M * F.ln(F.tan(math.pi / 4 + F.radians(latitude) / 2))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test; `ring` is an array of (x, y) structs whose last point joins the first."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + 1, n))
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def geodesic_km(latitude1: Column, longitude1: Column, latitude2: Column, longitude2: Column) -> Column:
    """Length of the geodesic on the ellipsoid by Vincenty's inverse series, in Arrow batches."""

    @F.pandas_udf("double")
    def inverse(p1: pd.Series, l1: pd.Series, p2: pd.Series, l2: pd.Series) -> pd.Series:
        return pd.Series(vincenty_inverse(*(np.asarray(c, dtype=float) for c in (p1, l1, p2, l2))))

    return inverse(latitude1, longitude1, latitude2, longitude2)


def _arc_km(chord: Column, radius: float) -> Column:
    return 2 * radius * F.asin(F.least(chord / (2 * radius), F.lit(1.0)))


def least_geodesic_km(chord: Column) -> Column:
    """No geodesic between points of the surface at this straight distance in km is shorter."""
    return 0.994 * _arc_km(chord, MOST_CURVATURE_KM)


def most_geodesic_km(chord: Column) -> Column:
    """No geodesic between points of the surface at this straight distance in km is longer."""
    return 1.006 * _arc_km(chord, LEAST_CURVATURE_KM)


def vincenty_inverse(p1: np.ndarray, l1: np.ndarray, p2: np.ndarray, l2: np.ndarray, rounds: int = 40) -> np.ndarray:
    minor = AXIS_KM * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(p))) for p in (p1, p2))
    span = np.radians(l2 - l1)
    lam = span.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s > 0, sin_s, 1), 0)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a > 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a > 0, cos2_a, 1), 0)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            last, lam = lam, span + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            if not (np.abs(lam - last) > 1e-13).any():
                break
        k = cos2_a * (AXIS_KM**2 - minor**2) / minor**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        inner = cos_s * (2 * cos_m**2 - 1) - small / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)
        return minor * big * (sigma - small * sin_s * (cos_m + small / 4 * inner))


def destination(latitude: Column, longitude: Column, azimuth: Column, metres: Column) -> Column:
    """struct(latitude, longitude, back) of the point at a geodesic distance along an azimuth in degrees, in Arrow batches.

    `back` is the azimuth from there to the start, from 0 to 360 degrees.
    """

    @F.pandas_udf("struct<latitude:double,longitude:double,back:double>")
    def direct(p: pd.Series, l: pd.Series, a: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("latitude", "longitude", "back"), vincenty_ends(*(np.asarray(c, dtype=float) for c in (p, l, a, s))), strict=True)))

    # Else the optimiser works a point out again for each use of its two fields: 16 times at the end of four steps.
    return direct.asNondeterministic()(latitude, longitude, azimuth, metres)


def vincenty_direct(p: np.ndarray, l: np.ndarray, azimuth: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes of the ends."""
    return vincenty_ends(p, l, azimuth, metres)[:2]


def vincenty_ends(p: np.ndarray, l: np.ndarray, azimuth: np.ndarray, metres: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitudes, longitudes and azimuths back to the start by Vincenty's direct series; a distance of 0 stays in place."""
    minor = AXIS_KM * (1 - FLATTENING)
    u, a = np.arctan((1 - FLATTENING) * np.tan(np.radians(p))), np.radians(azimuth)
    sin_a = np.cos(u) * np.sin(a)
    cos2_a = 1 - sin_a**2
    start = np.arctan2(np.tan(u), np.cos(a))
    k = cos2_a * (AXIS_KM**2 - minor**2) / minor**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    first = metres / 1000 / (minor * big)
    sigma = first
    for _ in range(rounds):
        mid = np.cos(2 * start + sigma)
        inner = np.cos(sigma) * (2 * mid**2 - 1) - small / 6 * mid * (4 * np.sin(sigma) ** 2 - 3) * (4 * mid**2 - 3)
        sigma = first + small * np.sin(sigma) * (mid + small / 4 * inner)
    mid = np.cos(2 * start + sigma)
    across = np.sin(u) * np.sin(sigma) - np.cos(u) * np.cos(sigma) * np.cos(a)
    lat = np.arctan2(np.sin(u) * np.cos(sigma) + np.cos(u) * np.sin(sigma) * np.cos(a), (1 - FLATTENING) * np.hypot(sin_a, across))
    lam = np.arctan2(np.sin(sigma) * np.sin(a), np.cos(u) * np.cos(sigma) - np.sin(u) * np.sin(sigma) * np.cos(a))
    c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
    span = lam - (1 - c) * FLATTENING * sin_a * (sigma + c * np.sin(sigma) * (mid + c * np.cos(sigma) * (2 * mid**2 - 1)))
    back = np.mod(np.degrees(np.arctan2(sin_a, -across)) + 180, 360)
    return np.degrees(lat), l + np.degrees(span), back
