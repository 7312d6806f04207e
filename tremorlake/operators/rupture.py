"""Distances from stations to ruptures: points, finite-fault models, or planes scaled from the magnitude."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import geo
from tremorlake.functions.lineage import checkpointed

#: From this magnitude a rupture is not a point; powers of ten of length and width in km.
EXTENDED = 7.1
LENGTH, WIDTH = (-2.9, 0.63), (-0.86, 0.35)
#: Fixed value: share of the range of slips below which a sub-fault does not count.
SLIP_SHARE = 0.15
#: Side of the cubes that points are met by, and the greatest distance from their centre; parts of the stations of an event.
CELL_KM, PARTS = 5.0, 16
HALF_KM = CELL_KM * math.sqrt(3) / 2

Bound = Callable[[Column], Column]


def fault_size(magnitude: Column) -> tuple[Column, Column]:
    """Length and width in km."""
    return tuple(F.pow(F.lit(10.0), a + b * magnitude) for a, b in (LENGTH, WIDTH))


def sub_faults(planes: DataFrame) -> DataFrame:
    """One row (i along the strike, j up the dip; lat, lon in degrees, deep in km) for each node of each plane.

    `planes` has event, latitude, longitude, depth, strike, dip, length and width (km). Nodes
    are about 1 km apart: floor(length) by floor(width). A plane of fewer than two nodes in a direction gives none.
    """
    metres, dip = F.col("width") * 1000, F.radians("dip")
    p = planes.withColumns({"nx": F.floor("length").cast("int"), "ny": F.floor("width").cast("int")}).where("nx > 1 AND ny > 1")
    p = p.withColumn("__edge", geo.destination(F.col("latitude"), F.col("longitude"), F.col("strike") + 90, metres / 2 * F.cos(dip)))
    p = p.withColumn("__corner", geo.destination(F.col("__edge.latitude"), F.col("__edge.longitude"), F.col("strike"), F.col("length") * 500))
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    along = F.col("length") * 1000 / (F.col("nx") - 1) * F.col("i")
    p = p.withColumn("__row", geo.destination(F.col("__corner.latitude"), F.col("__corner.longitude"), F.col("strike") - 180, along))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    up = metres / (F.col("ny") - 1) * F.col("j")
    p = p.withColumn("__node", geo.destination(F.col("__row.latitude"), F.col("__row.longitude"), F.col("strike") - 90, up))
    deep = F.col("depth") + F.col("width") / 2 * F.sin(dip) - up * F.sin(dip) / 1000
    return p.select("event", "i", "j", "nx", "ny", F.col("__node.latitude").alias("lat"), F.col("__node.longitude").alias("lon"), deep.alias("deep"))


def _place(lat: str, lon: str, depth_km: Column) -> tuple[Column, Column, Column]:
    return geo.ecef(F.col(lat), F.col(lon), depth_km)


def _cell(place: tuple[Column, Column, Column]) -> Column:
    return F.struct(*(F.floor(c / CELL_KM).alias(k) for c, k in zip(place, "xyz", strict=True)))


def _parts(rows: DataFrame) -> DataFrame:
    """Stations dealt over the parts of their event, so that no event is one task."""
    return rows.withColumn("part", F.pmod(F.xxhash64("station"), F.lit(PARTS)))


def _in_all_parts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))


def _least(pairs: DataFrame, points: DataFrame, deep: Column, low: Bound, high: Bound, distance: Column, name: str) -> DataFrame:
    """Least distance to the points of the event, for each (event, station), by cells.

    Points lie in cubes by their place at depth `deep`. A cube whose least possible distance, `low` of the chord
    to its near side, is over the greatest possible one of the nearest cube cannot hold the nearest point; its
    points are not met. What meets a station first is a list of the cubes of its event, not of its points.
    """
    nodes = points.withColumn("cell", _cell(_place("lat", "lon", deep)))
    cubes = nodes.select("event", "cell").distinct().groupBy("event").agg(F.collect_list("cell").alias("cells"))
    here = _place("station_lat", "station_lon", F.lit(0.0))

    def to_centre(cell: Column) -> Column:
        return geo.straight_distance(tuple((cell[k] + 0.5) * CELL_KM for k in "xyz"), here)

    def near_ones(least: Column) -> Column:
        return F.filter("cells", lambda c: low(F.greatest(to_centre(c) - HALF_KM, F.lit(0.0))) <= high(least + HALF_KM))

    # Bound to a name of a lambda, the least distance is worked out once for each station and not for each cube.
    near = F.transform(F.array(F.array_min(F.transform("cells", to_centre))), near_ones)[0]
    # A number of partitions is given, or else adaptive execution joins rows of few bytes and much work in one task.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _parts(pairs.select("event", "station", "station_lat", "station_lon")).repartition(tasks, "event", "part").join(_in_all_parts(cubes), ["event", "part"])
    met = met.select("event", "part", "station", "station_lat", "station_lon", F.explode(near).alias("cell")).repartition(tasks, "event", "part", "cell")
    both = met.join(_in_all_parts(nodes), ["event", "part", "cell"]).select("event", "station", distance.alias(name))
    return both.groupBy("event", "station").agg(F.min(name).alias(name))


def _nearest(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Least straight and geodesic distance to the points of the event, for each (event, station)."""
    here = _place("station_lat", "station_lon", F.lit(0.0))
    straight = geo.straight_distance(_place("lat", "lon", F.col("deep")), here)
    flat = geo.geodesic_km(F.col("station_lat"), F.col("station_lon"), F.col("lat"), F.col("lon"))
    one = _least(pairs, points, F.col("deep"), lambda c: c, lambda c: c, straight, "straight")
    two = _least(pairs, points, F.lit(0.0), geo.least_geodesic_km, geo.most_geodesic_km, flat, "flat")
    return one.join(two, ["event", "station"])


def _with_models(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Rings of (lon, lat, depth in m), the last point of each left out; a station inside one in the plane of x and y is at 0."""
    event = F.max("slip"), F.min("slip")
    range_of = models.groupBy("event").agg(event[0].alias("hi"), event[1].alias("lo"))
    used = models.join(range_of, "event").where(F.col("slip") >= F.col("lo") + SLIP_SHARE * (F.col("hi") - F.col("lo")))
    used = used.select("event", F.slice("ring", 1, F.greatest(F.size("ring") - 1, F.lit(0))).alias("ring"))
    points = used.select("event", F.explode("ring").alias("q")).select("event", F.col("q.lon").alias("lon"), F.col("q.lat").alias("lat"), (F.col("q.depth_m") / 1000).alias("deep"))

    def flat(q: Column) -> Column:
        x, y, _ = geo.ecef(q["lat"], q["lon"], q["depth_m"] / 1000)
        return F.struct(x.alias("x"), y.alias("y"))

    x, y, _ = _place("station_lat", "station_lon", F.lit(0.0))
    rings = used.where(F.size("ring") > 2).select("event", F.transform("ring", flat).alias("ring"))
    above = _parts(pairs).join(_in_all_parts(rings), ["event", "part"]).groupBy("event", "station").agg(F.max(geo.in_polygon(x, y, F.col("ring"))).alias("inside"))
    return _nearest(pairs, points).join(above, ["event", "station"], "left")


def _with_planes(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """Nodes of a plane scaled from the magnitude; a station inside its corners in longitude and latitude is at 0."""
    long, wide = fault_size(F.col("magnitude"))
    events = pairs.select("event", "latitude", "longitude", "depth", "magnitude").dropDuplicates(["event"])
    # Written once: corners and both kinds of distance read the nodes, twice each.
    nodes = checkpointed(sub_faults(events.join(planes, "event").withColumns({"length": long, "width": wide})))
    corner = (F.col("i").isin(0) | (F.col("i") == F.col("nx") - 1)) & (F.col("j").isin(0) | (F.col("j") == F.col("ny") - 1))
    turn = F.when(F.col("i") == 0, F.when(F.col("j") == 0, 0).otherwise(1)).otherwise(F.when(F.col("j") == 0, 3).otherwise(2))
    corners = nodes.where(corner).groupBy("event").agg(F.sort_array(F.collect_list(F.struct(turn.alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("ring"))
    above = _parts(pairs).join(_in_all_parts(corners), ["event", "part"]).select("event", "station", geo.in_polygon(F.col("station_lon"), F.col("station_lat"), F.col("ring")).alias("inside"))
    return _nearest(pairs, nodes.select("event", "lat", "lon", "deep")).join(above, ["event", "station"], "left")


def distances(pairs: DataFrame, models: DataFrame, planes: DataFrame) -> DataFrame:
    """One row per (event, station): rhypo, repi, rrup, rjb in km and method.

    `pairs` is keyed by (event, station) and has latitude, longitude, depth, magnitude, station_lat
    and station_lon; `models` has event, slip and ring (array of lon, lat, depth_m); `planes` has
    event, strike and dip, one row each. method is "point" below EXTENDED, "model" where the event
    has a model, "plane" where it has a plane, else "finite fault model required", with rrup and rjb
    null. A null magnitude is of the last kind unless there is a model. The stations of an event are
    dealt into PARTS; each meets the points of those cubes only that can hold the nearest one, and
    distances are aggregated before their shuffle.
    """
    keys = ["event", "station"]
    has_model = models.select("event").distinct().withColumn("has_model", F.lit(True))
    has_plane = planes.select("event").distinct().withColumn("has_plane", F.lit(True))
    point, scaled = F.col("magnitude") < EXTENDED, F.col("has_plane") & F.col("magnitude").isNotNull()
    method = F.when(point, "point").when(F.col("has_model"), "model").when(scaled, "plane").otherwise("finite fault model required")
    base = pairs.join(has_model, "event", "left").join(has_plane, "event", "left").withColumn("method", method)
    here, there = _place("station_lat", "station_lon", F.lit(0.0)), _place("latitude", "longitude", F.col("depth"))
    base = base.withColumns({
        "rhypo": geo.straight_distance(there, here),
        "repi": geo.geodesic_km(F.col("station_lat"), F.col("station_lon"), F.col("latitude"), F.col("longitude")),
    })
    found = _with_models(base.where("method = 'model'"), models).unionByName(_with_planes(base.where("method = 'plane'"), planes))
    out = base.join(found, keys, "left")
    rrup = F.when(F.col("method") == "point", F.col("rhypo")).otherwise(F.col("straight"))
    rjb = F.when(F.col("method") == "point", F.col("repi")).when(F.col("inside"), 0.0).otherwise(F.col("flat"))
    return out.select(*keys, "rhypo", "repi", rrup.alias("rrup"), rjb.alias("rjb"), "method")


#: Types of the models and planes that `distances` asks for.
MODELS, PLANES = "event {event}, slip double, ring array<struct<lon:double,lat:double,depth_m:double>>", "event {event}, strike double, dip double"


def _lists(pairs: DataFrame, models: DataFrame | None, planes: DataFrame | None, method: str) -> DataFrame:
    """(event, station, distances) of the pairs of one method: an array of rhypo, repi, rrup and rjb."""
    event = pairs.schema["event"].dataType.simpleString()
    none = lambda kind: pairs.sparkSession.createDataFrame([], kind.format(event=event))
    found = distances(pairs, none(MODELS) if models is None else models, none(PLANES) if planes is None else planes)
    return found.where(F.col("method") == method).select("event", "station", F.array("rhypo", "repi", "rrup", "rjb").alias("distances"))


def point_lists(pairs: DataFrame) -> DataFrame:
    """Distances of whole files of stations to ruptures that are points, those under EXTENDED."""
    return _lists(pairs.where(F.col("magnitude") < EXTENDED), None, None, "point")


def model_lists(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Distances of whole files of stations to ruptures with a finite-fault model."""
    return _lists(pairs.join(models.select("event").distinct(), "event", "left_semi"), models, None, "model")


def plane_lists(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """Distances of whole files of stations to ruptures of which only a plane is known."""
    return _lists(pairs.join(planes.select("event").distinct(), "event", "left_semi"), None, planes, "plane")
