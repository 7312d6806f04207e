"""The library's functions under names for SQL.

All but the geodesics are functions that Spark puts into the query's plan; these two are Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import geo
from tremorlake.operators import rupture

_MINOR = geo.AXIS_KM * (1 - geo.FLATTENING)

#: Name and parameters, what it returns, and its body.
FUNCTIONS = {
    "earth_centred(latitude DOUBLE, longitude DOUBLE, depth_km DOUBLE)": (
        "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>",
        f"""element_at(transform(array(sqrt(pow({geo.AXIS_KM}D * cos(radians(latitude)), 2) + pow({_MINOR}D * sin(radians(latitude)), 2))), d -> named_struct(
            'x', ({geo.AXIS_KM**2}D / d - depth_km) * cos(radians(latitude)) * cos(radians(longitude)),
            'y', ({geo.AXIS_KM**2}D / d - depth_km) * cos(radians(latitude)) * sin(radians(longitude)), 'z', ({_MINOR**2}D / d - depth_km) * sin(radians(latitude)))), 1)""",
    ),
    "straight_km(a STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>, b STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>)": ("DOUBLE", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"),
    "hypocentral_km(latitude DOUBLE, longitude DOUBLE, depth_km DOUBLE, station_latitude DOUBLE, station_longitude DOUBLE)": (
        "DOUBLE", "straight_km(earth_centred(latitude, longitude, depth_km), earth_centred(station_latitude, station_longitude, 0D))",
    ),
    "mercator(longitude DOUBLE, latitude DOUBLE)": (
        "STRUCT<x: DOUBLE, y: DOUBLE>", f"named_struct('x', {geo.MERCATOR_M}D * radians(longitude), 'y', {geo.MERCATOR_M}D * ln(tan(pi() / 4 + radians(latitude) / 2)))",
    ),
    "fault_km(magnitude DOUBLE)": ("STRUCT<length: DOUBLE, width: DOUBLE>", "named_struct({})".format(", ".join(f"'{n}', pow(10D, {a}D + {b}D * magnitude)" for n, (a, b) in (("length", rupture.LENGTH), ("width", rupture.WIDTH))))),
    "in_polygon(x DOUBLE, y DOUBLE, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>)": (
        "BOOLEAN",
        """size(filter(zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (p, q) -> named_struct('p', p, 'q', q)), e -> (e.p.y > y) <> (e.q.y > y)
            AND x < (e.q.x - e.p.x) * (y - e.p.y) / nullif(e.q.y - e.p.y, 0D) + e.p.x)) % 2 = 1""",
    ),
    "velocity_of(sa DOUBLE, period DOUBLE)": ("DOUBLE", "sa * period / (2 * pi())"),
}

#: An oscillator of each period under a record, by average acceleration; the peak of the record at period 0, null for a record without samples.
SPECTRUM = """
CREATE OR REPLACE TEMPORARY FUNCTION spectrum_of(samples ARRAY<DOUBLE>, dt DOUBLE, periods ARRAY<DOUBLE>, damping DOUBLE)
RETURNS TABLE(period DOUBLE, sa DOUBLE) RETURN
SELECT t, CASE WHEN coalesce(size(samples), 0) = 0 THEN NULL WHEN t = 0 THEN array_max(transform(samples, x -> abs(x))) ELSE w * w * aggregate(
    slice(samples, 2, size(samples)), named_struct('u', 0D, 'v', 0D, 'a', -element_at(samples, 1), 'peak', 0D),
    (s, x) -> element_at(transform(transform(array((-x - s.a * (damping * w * dt + w * w * dt * dt / 4) - s.v * (2 * damping * w + w * w * dt) - s.u * w * w) / (1 + damping * w * dt + w * w * dt * dt / 4)),
        n -> named_struct('u', s.u + s.v * dt + dt * dt / 4 * (s.a + n), 'v', s.v + dt / 2 * (s.a + n), 'a', n)),
        m -> named_struct('u', m.u, 'v', m.v, 'a', m.a, 'peak', greatest(s.peak, abs(m.u)))), 1)).peak END
FROM (SELECT t, 2 * pi() / nullif(t, 0D) AS w FROM explode(periods) AS p(t))
"""


def _geodesic_km(p1: pd.Series, l1: pd.Series, p2: pd.Series, l2: pd.Series) -> pd.Series:
    return pd.Series(geo.vincenty_inverse(*(np.asarray(c, dtype=float) for c in (p1, l1, p2, l2))))


def _geodesic_end(p: pd.Series, l: pd.Series, azimuth: pd.Series, metres: pd.Series) -> pd.DataFrame:
    made = geo.vincenty_ends(*(np.asarray(c, dtype=float) for c in (p, l, azimuth, metres)))
    return pd.DataFrame(dict(zip(("latitude", "longitude", "back"), made, strict=True)))


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names. They give null for null; registering again changes nothing."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.sql(SPECTRUM)
    spark.udf.register("geodesic_km", F.pandas_udf(_geodesic_km, "double"))
    spark.udf.register("geodesic_end", F.pandas_udf(_geodesic_end, "struct<latitude:double,longitude:double,back:double>"))
    return [h.partition("(")[0] for h in FUNCTIONS] + ["spectrum_of", "geodesic_km", "geodesic_end"]
