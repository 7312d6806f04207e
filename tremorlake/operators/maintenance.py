"""Jobs over whole archives of records: repairs from raw text, refreshed distances, corrections, map payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions import geo
from tremorlake.operators import curation, records, rupture

COMPONENTS = (1, 2, 3)
DISTANCES = ("rhypo", "repi", "rrup", "rjb")


def repair_records(held: DataFrame, outliers: DataFrame, raw: DataFrame) -> DataFrame:
    """Records of `outliers` with their samples read anew from raw channels; one row for each (event, station) among them.

    `held` has event, station, dt and component_k, the name of each component's channel; `outliers` has event and station;
    `raw` has event, station, channel, start and values, as archives are read, of several texts of one channel the one that
    starts last. Components take the values of the channel of their name, with zeros before those that start later and
    after them up to one length. Adds uncorrected_k (null where no channel has the name), empty corrected_k and filtered_k,
    status PENDING, corrected false. An outlier without a record is left out; a raw channel without values is none.
    """
    asked = held.join(outliers.select("event", "station").distinct(), ["event", "station"], "left_semi")
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"component_{k}").alias("channel")) for k in COMPONENTS]))
    wanted = asked.select("event", "station", names.alias("c")).select("event", "station", "c.k", "c.channel").where("channel IS NOT NULL")
    seconds = F.unix_micros(F.col("start").cast("timestamp")) / 1e6
    read = raw.where("values IS NOT NULL AND start IS NOT NULL").join(wanted, ["event", "station", "channel"])
    of = lambda k: F.when(F.col("k") == k, F.struct(seconds.alias("t"), "values"))
    found = read.groupBy("event", "station").agg(*[F.max(of(k)).alias(f"__{k}") for k in COMPONENTS])
    made = asked.join(found, ["event", "station"], "left")
    made = made.withColumns({f"__v{k}": F.col(f"__{k}.values") for k in COMPONENTS} | {f"__t{k}": F.col(f"__{k}.t") for k in COMPONENTS})
    whole = records.aligned([f"__v{k}" for k in COMPONENTS], [f"__t{k}" for k in COMPONENTS], F.col("dt"))
    none = F.array().cast("array<double>")
    new = {f"uncorrected_{k}": whole[f"__v{k}"] for k in COMPONENTS} | {f"{kind}_{k}": none for kind in ("corrected", "filtered") for k in COMPONENTS}
    new |= {"status": F.lit("PENDING"), "corrected": F.lit(False)}
    return made.withColumns(new).drop(*[f"__{c}{k}" for c in ("", "v", "t") for k in COMPONENTS])


def refresh_distances(flat: DataFrame, models: DataFrame, planes: DataFrame, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """The flat file with distances worked out where any of the four is missing, and the keys and distances of the rows that changed.

    `flat` has event, station, what `rupture.distances` asks for and the four distances, under 0 or null where they are
    not known. Rows that lack an input stay. Distances to a rupture that no model and no plane is known of are -1. Only rows
    of which a distance differs by `tolerance` count as changed: by their keys states and spectra are dated anew.
    """
    inputs = ("magnitude", "latitude", "longitude", "depth", "station_lat", "station_lon")
    lacking = flat.where(curation.lacks_distances([F.col(c) for c in DISTANCES], [F.col(c) for c in inputs]))
    found = rupture.distances(lacking.drop(*DISTANCES), models, planes).withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("rrup", "rjb")})
    old = lacking.select("event", "station", *[F.col(c).alias(f"__{c}") for c in DISTANCES])
    differ = [curation.differs(F.col(f"__{c}").cast("string"), F.col(c).cast("string"), tolerance) for c in DISTANCES]
    changed = found.join(old, ["event", "station"]).where(F.exists(F.array(*differ), lambda d: d)).select("event", "station", *DISTANCES)
    return curation.refresh(flat, changed, ["event", "station"], list(DISTANCES)), changed


def correct_components(held: DataFrame, correct: Callable[[Column, Column], Column], now: Column) -> DataFrame:
    """Records with corrected_k = correct(uncorrected_k, position) where they are valid and not corrected yet.

    These have p_wave set to the position, last_update and updated to `now` and corrected to true; of the others all stays.
    A missing component stays missing.
    """
    ready = curation.ready_to_correct(F.lower("status").eqNullSafe("valid").cast("string"), F.col("corrected")) & F.col("position").isNotNull()
    new = {f"corrected_{k}": F.when(ready, correct(F.col(f"uncorrected_{k}"), F.col("position"))).otherwise(F.col(f"corrected_{k}")) for k in COMPONENTS}
    new |= {"p_wave": F.when(ready, F.col("position")).otherwise(F.col("p_wave")), "corrected": ready | F.coalesce("corrected", F.lit(False))}
    new |= {c: F.when(ready, now).otherwise(F.col(c)) for c in ("last_update", "updated")}
    return held.withColumns(new)


def map_payload(hypocentres: DataFrame, stations: DataFrame, models: DataFrame, margin: float = 30_000.0) -> DataFrame:
    """What a map of each event shows, in the plane of the spherical Mercator: bounds, slips and polygons.

    `hypocentres` has event, latitude, longitude; `stations` event, latitude, longitude; `models` event, slip and ring (lon,
    lat, depth_m). One row for each event: x and y of the hypocentre, the square around all points with `margin` to spare,
    the number of stations, low and high slip and polygons (array of slip and ring of x and y); null slips and no polygons
    without a model. A polygon is a patch of a rupture, of which an event has hundreds at most.
    """
    flat = lambda lon, lat: [c.alias(n) for c, n in zip(geo.mercator(lon, lat), "xy", strict=True)]
    centre = hypocentres.select("event", *flat(F.col("longitude"), F.col("latitude")))
    places = stations.select("event", *flat(F.col("longitude"), F.col("latitude")))
    rings = models.select("event", "slip", F.transform("ring", lambda p: F.struct(*flat(p["lon"], p["lat"]))).alias("ring"))
    corners = rings.select("event", F.explode("ring").alias("p")).select("event", "p.x", "p.y")
    bounds = records.square_bounds(centre.unionByName(places).unionByName(corners), "event", "x", "y", margin)
    slips = rings.groupBy("event").agg(F.min("slip").alias("low"), F.max("slip").alias("high"), F.array_sort(F.collect_list(F.struct("slip", "ring"))).alias("polygons"))
    made = centre.join(bounds, "event").join(places.groupBy("event").agg(F.count("*").alias("stations")), "event", "left").join(slips, "event", "left")
    return made.withColumns({"stations": F.coalesce("stations", F.lit(0)), "polygons": F.coalesce("polygons", F.array().cast(slips.schema["polygons"].dataType))})
