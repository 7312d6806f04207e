import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import geo
from tremorlake.operators import rupture


def test_direct_geodesic_inverts_the_inverse_one():
    random = np.random.default_rng(1)
    p, l, a, s = random.uniform(-60, 60, 50), random.uniform(-170, 170, 50), random.uniform(-360, 360, 50), random.uniform(0, 3e5, 50)
    s[0] = 0
    lat, lon = geo.vincenty_direct(p, l, a, s)
    assert geo.vincenty_inverse(p, l, lat, lon)[1:] == pytest.approx(s[1:] / 1000, abs=1e-6)
    assert (lat[0], lon[0]) == pytest.approx((p[0], l[0]))


PLANES = "event string, latitude double, longitude double, depth double, strike double, dip double, length double, width double"


def test_grid_of_a_plane(spark):
    df = spark.createDataFrame([("a", -33.0, -71.0, 30.0, 0.0, 30.0, 10.5, 5.2), ("b", 0.0, 0.0, 1.0, 0.0, 0.0, 1.5, 9.0)], PLANES)
    rows = rupture.sub_faults(df).collect()
    assert {r.event for r in rows} == {"a"} and len(rows) == 50
    at = {(r.i, r.j): r for r in rows}
    half = 5.2 / 2 * np.sin(np.radians(30))
    assert at[0, 0].deep == pytest.approx(30 + half) and at[9, 4].deep == pytest.approx(30 - half)
    assert geo.vincenty_inverse(*(np.array([v]) for v in (at[0, 0].lat, at[0, 0].lon, at[9, 0].lat, at[9, 0].lon)))[0] == pytest.approx(10.5, abs=1e-4)
    assert at[0, 0].lat > at[9, 0].lat and at[0, 0].lon > at[0, 4].lon


def test_dispatch_of_distances(spark):
    schema = "event string, station string, latitude double, longitude double, depth double, magnitude double, station_lat double, station_lon double"
    events = {"small": 6.0, "model": 8.0, "plane": 7.5, "none": 7.5, "null": None}
    stations = {"near": (-33.0, -71.0), "far": (-36.0, -71.0)}
    pairs = spark.createDataFrame([(e, s, -33.0, -71.0, 30.0, m, *at) for e, m in events.items() for s, at in stations.items()], schema)
    # A ring far below the surface moves away from a station above it in the plane of x and y: this one is shallow.
    square = [(-71.2, -33.2, 2e3), (-70.8, -33.2, 2e3), (-70.8, -32.8, 2e3), (-71.2, -32.8, 2e3), (-71.2, -33.2, 2e3)]
    remote = [(-71.2, -36.0, 2e3)] * 5
    models = spark.createDataFrame([("model", 9.0, square), ("model", 0.0, remote)], "event string, slip double, ring array<struct<lon:double,lat:double,depth_m:double>>")
    planes = spark.createDataFrame([("plane", 10.0, 20.0)], "event string, strike double, dip double")
    got = {(r.event, r.station): r for r in rupture.distances(pairs, models, planes).collect()}
    assert len(got) == 10
    for s in stations:
        small, none = got["small", s], got["none", s]
        assert (small.rrup, small.rjb, small.method) == (small.rhypo, small.repi, "point")
        assert none.rrup is None and none.rjb is None and none.method == got["null", s].method == "finite fault model required"
    for e in ("model", "plane"):
        assert got[e, "near"].rjb == 0 and got[e, "near"].method == e
        assert got[e, "far"].repi > got[e, "far"].rjb > 150 and got[e, "far"].rrup > 150
    lon, lat = np.array(square)[:4, :2].T
    assert got["model", "far"].rjb == pytest.approx(geo.vincenty_inverse(np.full(4, -36.0), np.full(4, -71.0), lat, lon).min(), abs=1e-6)
    assert rupture.distances(pairs.limit(0), models, planes).count() == 0


def test_bounds_of_geodesics_hold(spark):
    random = np.random.default_rng(3)
    p, q = random.uniform(-89, 89, (2, 4000))
    l, m = random.uniform(-180, 180, (2, 4000))
    q[:2000], m[:2000] = p[:2000] + random.uniform(-1, 1, 2000), l[:2000] + random.uniform(-1, 1, 2000)
    rows = spark.createDataFrame(pd.DataFrame({"p": p, "l": l, "q": q, "m": m}))
    chord = geo.straight_distance(geo.ecef(F.col("p"), F.col("l"), F.lit(0.0)), geo.ecef(F.col("q"), F.col("m"), F.lit(0.0)))
    far = geo.geodesic_km(F.col("p"), F.col("l"), F.col("q"), F.col("m"))
    rows = rows.select(chord.alias("c"), far.alias("d")).where("d < 19500")
    assert rows.count() > 3900
    assert rows.where(~F.col("d").between(geo.least_geodesic_km(F.col("c")), geo.most_geodesic_km(F.col("c")))).count() == 0


def test_least_distances_by_cells_equal_those_of_all_pairs(spark):
    random = np.random.default_rng(4)
    points = pd.DataFrame({"event": random.integers(0, 3, 600), "lat": random.uniform(-34, -32, 600), "lon": random.uniform(-72, -70, 600), "deep": random.uniform(0, 60, 600)})
    stations = pd.DataFrame({"event": random.integers(0, 4, 200), "station": np.arange(200), "station_lat": random.uniform(-40, -28, 200), "station_lon": random.uniform(-75, -68, 200)})
    # Copies of a point and a station on a point.
    points = pd.concat([points, points[:50]])
    stations.loc[0, ["event", "station_lat", "station_lon"]] = points.iloc[0][["event", "lat", "lon"]].to_numpy()
    found = rupture._nearest(spark.createDataFrame(stations), spark.createDataFrame(points)).collect()
    both = stations.merge(points, on="event")
    both["flat"] = geo.vincenty_inverse(*(both[c].to_numpy() for c in ("station_lat", "station_lon", "lat", "lon")))
    assert {(r.event, r.station) for r in found} == set(zip(both.event, both.station, strict=True))
    flat = both.groupby(["event", "station"]).flat.min()
    place = lambda lat, lon, deep: np.stack([np.asarray(c) for c in ecef(lat, lon, deep)])
    both["straight"] = np.sqrt(((place(both.lat, both.lon, both.deep) - place(both.station_lat, both.station_lon, 0.0)) ** 2).sum(axis=0))
    straight = both.groupby(["event", "station"]).straight.min()
    for r in found:
        assert r.flat == pytest.approx(flat[r.event, r.station], abs=1e-6) and r.straight == pytest.approx(straight[r.event, r.station], abs=1e-6)


def ecef(lat, lon, deep):
    a, b, p, l = geo.AXIS_KM, geo.AXIS_KM * (1 - geo.FLATTENING), np.radians(lat), np.radians(lon)
    d = np.sqrt((a * np.cos(p)) ** 2 + (b * np.sin(p)) ** 2)
    flat = (a * a / d - deep) * np.cos(p)
    return flat * np.cos(l), flat * np.sin(l), (b * b / d - deep) * np.sin(p)
