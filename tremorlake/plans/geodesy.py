"""SQL of geodesics on the ellipsoid, as chains of named steps, for the queries' SQL."""

from __future__ import annotations

from tremorlake.functions.geo import AXIS_KM, FLATTENING

ROUNDS = 8
_MINOR = f"({AXIS_KM} * (1 - {FLATTENING!r}))"
_SERIES = "1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS big, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS small"


def _chain(name: str, source: str, levels: list[str]) -> str:
    """Named steps, each over the one before; an item of a level `x = e` replaces a column, others add some."""
    made, last = [f"{name}_from AS MATERIALIZED (SELECT * FROM {source})"], f"{name}_from"
    for n, level in enumerate(levels):
        here = f"{name} AS MATERIALIZED" if n == len(levels) - 1 else f"{name}_{n} AS"
        made.append(f"{here} (SELECT * REPLACE ({level[1:]}) FROM {last})" if level.startswith("=") else f"{here} (SELECT *, {level} FROM {last})")
        last = here.split()[0]
    return ",\n".join(made)


def inverse(name: str, source: str) -> str:
    """Steps up to `name`: the columns of `source` and km, the geodesic from (p1, l1) to (p2, l2) in degrees."""
    f = repr(FLATTENING)
    turn = [
        "= sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs",
        "= atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa",
        "= 1 - sa * sa AS ca",
        f"= CASE WHEN ca > 0 THEN cs - 2 * sin(u1) * sin(u2) / ca ELSE 0 END AS cm, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS c",
        f"= radians(l2 - l1) + (1 - c) * {f} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS lam",
    ]
    zeros = ", ".join(f"0::DOUBLE AS {c}" for c in ("ss", "cs", "sg", "sa", "ca", "cm", "c"))
    first = f"atan((1 - {f}) * tan(radians(p1))) AS u1, atan((1 - {f}) * tan(radians(p2))) AS u2, radians(l2 - l1)::DOUBLE AS lam, {zeros}"
    end = f"{_MINOR} * big * (sg - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS km"
    return _chain(name, source, [first, *turn * ROUNDS, f"ca * (pow({AXIS_KM}, 2) - pow({_MINOR}, 2)) / pow({_MINOR}, 2) AS k", _SERIES, end])


def direct(name: str, source: str, start: tuple[str, str], azimuth: str, metres: str) -> str:
    """Steps up to `name`: the columns of `source`, {name}_lat and {name}_lon, the point at a distance along an azimuth."""
    f = repr(FLATTENING)
    turn = [
        "= cos(2 * s0 + sg) AS mid",
        "= first + small * sin(sg) * (mid + small / 4 * (cos(sg) * (2 * mid * mid - 1) - small / 6 * mid * (4 * pow(sin(sg), 2) - 3) * (4 * mid * mid - 3))) AS sg",
    ]
    levels = [
        f"atan((1 - {f}) * tan(radians({start[0]}))) AS u, radians({azimuth}) AS a",
        "atan2(tan(u), cos(a)) AS s0, cos(u) * sin(a) AS sa, 1 - pow(cos(u) * sin(a), 2) AS ca",
        f"ca * (pow({AXIS_KM}, 2) - pow({_MINOR}, 2)) / pow({_MINOR}, 2) AS k, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS c",
        _SERIES,
        f"({metres}) / 1000 / ({_MINOR} * big) AS first",
        "first AS sg, 0::DOUBLE AS mid",
        *turn * ROUNDS,
        turn[0],
        f"degrees(atan2(sin(u) * cos(sg) + cos(u) * sin(sg) * cos(a), (1 - {f}) * sqrt(sa * sa + pow(sin(u) * sin(sg) - cos(u) * cos(sg) * cos(a), 2)))) AS {name}_lat, "
        f"{start[1]} + degrees(atan2(sin(sg) * sin(a), cos(u) * cos(sg) - sin(u) * sin(sg) * cos(a)) - (1 - c) * {f} * sa * (sg + c * sin(sg) * (mid + c * cos(sg) * (2 * mid * mid - 1)))) AS {name}_lon",
    ]
    return _chain(f"{name}_all", source, levels) + f",\n{name} AS (SELECT * EXCLUDE (u, a, s0, sa, ca, k, c, big, small, first, sg, mid) FROM {name}_all)"


def _place(lat: str, lon: str, depth: str) -> tuple[str, str, str]:
    d = f"sqrt(pow({AXIS_KM} * cos(radians({lat})), 2) + pow({_MINOR} * sin(radians({lat})), 2))"
    flat = f"(pow({AXIS_KM}, 2) / {d} - {depth}) * cos(radians({lat}))"
    return f"{flat} * cos(radians({lon}))", f"{flat} * sin(radians({lon}))", f"(pow({_MINOR}, 2) / {d} - {depth}) * sin(radians({lat}))"


def _straight(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    return "sqrt(" + " + ".join(f"pow({p} - {q}, 2)" for p, q in zip(a, b, strict=True)) + ")"


EPICENTRAL = f"""
WITH s AS (SELECT c_custkey, -(c_custkey % 60)::DOUBLE - 0.5 AS p1, -(c_nationkey + 60.25)::DOUBLE AS l1, -33.4::DOUBLE AS p2, -70.6::DOUBLE AS l2 FROM customer),
{inverse("g", "s")}
SELECT c_custkey, round(km, 5) AS repi FROM g
"""

_HERE = _place("slat", "slon", "0")
RUPTURE = f"""
WITH ev AS (SELECT n_nationkey AS event, -20::DOUBLE - n_nationkey AS lat0, -70::DOUBLE - n_nationkey / 10 AS lon0, 20::DOUBLE + n_nationkey AS depth0,
    CASE WHEN n_nationkey % 2 = 0 THEN 'point' WHEN n_nationkey % 3 = 0 THEN 'model' WHEN n_nationkey % 3 = 1 THEN 'plane' ELSE 'finite fault model required' END AS method FROM nation),
pr AS (SELECT *, slat AS p1, slon AS l1, lat0 AS p2, lon0 AS l2, {_straight(_HERE, _place("lat0", "lon0", "depth0"))} AS rhypo
    FROM (SELECT c_custkey AS station, c_nationkey AS event, -20::DOUBLE - c_custkey % 250 / 10 AS slat, -70::DOUBLE - c_custkey % 30 / 10 AS slon FROM customer) JOIN ev USING (event)),
{inverse("epi", "pr")},
size AS (SELECT event, lat0, lon0, depth0, 10::DOUBLE AS strike, radians(20::DOUBLE) AS dip, pow(10, -2.9 + 0.63 * 7.5)::DOUBLE AS len, pow(10, -0.86 + 0.35 * 7.5)::DOUBLE AS wid FROM ev WHERE method = 'plane'),
{direct("e", "size", ("lat0", "lon0"), "strike + 90", "wid * 500 * cos(dip)")},
{direct("q", "e", ("e_lat", "e_lon"), "strike", "len * 500")},
along AS (SELECT *, floor(len) - 1 AS ni, unnest(range(0, floor(len)::BIGINT)) AS i FROM q),
{direct("r", "along", ("q_lat", "q_lon"), "strike - 180", "len * 1000 / ni * i")},
updip AS (SELECT *, floor(wid) - 1 AS nj, unnest(range(0, floor(wid)::BIGINT)) AS j FROM r),
{direct("n", "updip", ("r_lat", "r_lon"), "strike - 90", "wid * 1000 / nj * j")},
sq AS (SELECT event, unnest([0, 1, 2, 3]) AS k, lon0 + unnest([-0.2::DOUBLE, 0.2, 0.2, -0.2]) AS lon, lat0 + unnest([-0.2::DOUBLE, -0.2, 0.2, 0.2]) AS lat FROM ev WHERE method = 'model'),
pts AS (SELECT event, n_lat AS lat, n_lon AS lon, depth0 + wid / 2 * sin(dip) - wid / nj * j * sin(dip) AS deep FROM n UNION ALL SELECT event, lat, lon, 2.0 FROM sq),
met AS (SELECT event, station, slat AS p1, slon AS l1, pts.lat AS p2, pts.lon AS l2, {_straight(_HERE, _place("pts.lat", "pts.lon", "pts.deep"))} AS straight FROM pr JOIN pts USING (event)),
{inverse("flat", "met")},
least AS (SELECT event, station, min(straight) AS straight, min(km) AS flat FROM flat GROUP BY 1, 2),
ring AS (SELECT event, CASE WHEN i = 0 THEN CASE WHEN j = 0 THEN 0 ELSE 1 END ELSE CASE WHEN j = 0 THEN 3 ELSE 2 END END AS k, n_lon AS x, n_lat AS y FROM n WHERE i IN (0, ni) AND j IN (0, nj)
    UNION ALL SELECT event, k, {_place("lat", "lon", "2.0")[0]}, {_place("lat", "lon", "2.0")[1]} FROM sq),
edge AS (SELECT a.event, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN ring b ON a.event = b.event AND b.k = (a.k + 1) % 4),
here AS (SELECT event, station, CASE WHEN method = 'plane' THEN slon ELSE {_HERE[0]} END AS hx, CASE WHEN method = 'plane' THEN slat ELSE {_HERE[1]} END AS hy FROM pr WHERE method IN ('plane', 'model')),
within AS (SELECT here.event, station, count(*) FILTER (WHERE (y1 > hy) <> (y2 > hy) AND hx < (x2 - x1) * (hy - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside
    FROM here JOIN edge USING (event) GROUP BY 1, 2)
SELECT event, station, method, round(rhypo, 4) AS rhypo, round(km, 4) AS repi, round(CASE WHEN method = 'point' THEN rhypo ELSE straight END, 4) AS rrup,
    round(CASE WHEN method = 'point' THEN km WHEN inside THEN 0 ELSE flat END, 4) AS rjb
FROM epi LEFT JOIN least USING (event, station) LEFT JOIN within USING (event, station)
"""
