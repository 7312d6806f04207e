"""Queries of the jobs over archives of records, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import columns
from tremorlake.operators import maintenance, records, rupture, spectra
from tremorlake.plans import geodesy
from tremorlake.plans.catalog import DT, ORACLES, _record, _rounded, _ruptures, _table, query


@query("""
WITH e AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_' || (o_orderkey % 10) || '.5M_' || CASE WHEN o_custkey % 5 = 0 THEN 'latS' ELSE (o_custkey % 90) || 'S' END
    || '_' || CASE WHEN o_custkey % 7 = 0 THEN 'lonW' ELSE (o_custkey % 180) || 'W' END || '_' || (o_orderkey % 40) || '.5KM' || CASE WHEN o_orderkey % 3 = 0 THEN '_interface' ELSE '' END AS id FROM orders)
SELECT o_orderkey, id, CASE WHEN o_orderkey % 3 = 0 THEN 'Interface' END AS type, -TRY_CAST(replace(split_part(id, '_', 3), 'S', '') AS DOUBLE) AS latitude,
       -TRY_CAST(replace(split_part(id, '_', 4), 'W', '') AS DOUBLE) AS longitude, (o_orderkey % 40 + 0.5)::DOUBLE AS depth FROM e
""")
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of events with their type, taken apart again."""
    made = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", """concat(date_format(o_orderdate, 'yyyyMMdd'), '_', o_orderkey % 10, '.5M_', CASE WHEN o_custkey % 5 = 0 THEN 'latS' ELSE concat(o_custkey % 90, 'S') END, '_',
            CASE WHEN o_custkey % 7 = 0 THEN 'lonW' ELSE concat(o_custkey % 180, 'W') END, '_', o_orderkey % 40, '.5KM', CASE WHEN o_orderkey % 3 = 0 THEN '_interface' ELSE '' END) AS id""",
    )
    parts = columns.parsed_event_id(F.col("id"))
    return made.select("o_orderkey", "id", *[parts[c].alias(c) for c in ("type", "latitude", "longitude", "depth")])


_REMARK = "CASE WHEN o_orderkey % 5 = 0 THEN 'Finite fault model required' WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS {text}) END"


@query(f"""
WITH r AS (SELECT o_orderkey, {_REMARK.format(text="VARCHAR")} AS rrup, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 30 AS VARCHAR) END AS rjb FROM orders)
SELECT o_orderkey, CASE WHEN rrup LIKE 'F%' THEN -1 ELSE rrup::DOUBLE END AS rrup, CASE WHEN rrup LIKE 'F%' THEN -1 ELSE rjb::DOUBLE END AS rjb FROM r
""")
def rupture_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to ruptures from text: a remark in place of one makes both unknown."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_REMARK.format(text='STRING')} AS rrup", "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 30 AS STRING) END AS rjb")
    rrup, rjb = columns.rupture_pair(F.col("rrup"), F.col("rjb"))
    return rows.select("o_orderkey", rrup.alias("rrup"), rjb.alias("rjb"))


@query(f"""
WITH r AS ({ORACLES["response_spectrum"]}) SELECT vec_id, period, round(sa * period / (2 * pi()), 9) AS velocity FROM r
""")
def motion_velocity_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity spectra of the records' own response spectra."""
    periods = [0.0, 0.05, 0.2, 1.0]
    t = F.array(*map(F.lit, periods))
    made = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform(spectra.response_spectrum(_record(), DT, periods, 0.05), lambda s: F.round(s, 6)).alias("sa"))
    both = made.select("vec_id", F.explode(F.arrays_zip(t.alias("t"), records.velocity_spectrum(F.col("sa"), t).alias("v"))).alias("p"))
    return both.select("vec_id", F.col("p.t").alias("period"), F.round("p.v", 9).alias("velocity"))


@query("""
WITH e AS (SELECT vec_id, label, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak,
                  vec_id % 7 AS a, vec_id % 5 AS b, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 3 END AS c FROM embeddings),
f AS (SELECT *, least(a, b, c) AS first FROM e WHERE peak > 0.3),
g AS (SELECT *, (a - first) * 25 // 10 AS za, (b - first) * 25 // 10 AS zb, (c - first) * 25 // 10 AS zc FROM f)
SELECT label AS event, vec_id AS station, za AS zeros_1, zb AS zeros_2, zc AS zeros_3, greatest(za, zb, coalesce(zc, 0)) + n AS samples, round(total, 6) AS total_2, 0::BIGINT AS kept, 'PENDING' AS status, false AS corrected FROM g
""")
def repaired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a peak that stands out, read again from their raw channels and pending anew."""
    table = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("event"), F.col("vec_id").alias("station"), _record().alias("v"))
    old = F.array(F.lit(1.0))
    held = table.select("event", "station", F.lit(0.1).alias("dt"), F.lit("HNE").alias("component_1"), F.lit("HNN").alias("component_2"), F.lit("HNZ").alias("component_3"), *[old.alias(f"corrected_{k}") for k in (1, 2, 3)])
    outliers = table.where(F.array_max(F.transform("v", F.abs)) > 0.3)
    begin = F.lit("2010-02-27 06:34:08").cast("timestamp_ntz")
    start = lambda m: F.timestamp_add("MILLISECOND", F.col("station") % m * 250, begin)
    channels = F.array(
        F.struct(F.lit("HNE").alias("channel"), start(7).alias("start"), F.col("v").alias("values")), F.struct(F.lit("HNN").alias("channel"), start(5).alias("start"), F.col("v").alias("values")),
        F.struct(F.when(F.col("station") % 4 != 0, "HNZ").otherwise("HLX").alias("channel"), start(3).alias("start"), F.col("v").alias("values")),
    )
    raw = table.select("event", "station", F.explode(channels).alias("c")).select("event", "station", "c.*")
    made = maintenance.repair_records(held, outliers, raw)
    zeros = [records.first_where(F.col(f"uncorrected_{k}"), lambda v: v != 0).cast("long").alias(f"zeros_{k}") for k in (1, 2, 3)]
    total = F.round(F.aggregate("uncorrected_2", F.lit(0.0), lambda s, v: s + v), 6)
    kept = sum((F.size(f"{kind}_{k}") for kind in ("corrected", "filtered") for k in (1, 2, 3)), F.lit(0)).cast("long")
    return made.select("event", "station", *zeros, F.size("uncorrected_1").cast("long").alias("samples"), total.alias("total_2"), kept.alias("kept"), "status", "corrected")


@query(f"""
WITH r AS ({geodesy.RUPTURE})
SELECT event, station, CASE WHEN station % 4 = 0 THEN rhypo ELSE 5 END AS rhypo, CASE WHEN station % 4 = 0 THEN repi ELSE 5 END AS repi,
       CASE WHEN station % 4 = 0 THEN coalesce(rrup, -1) ELSE 5 END AS rrup, CASE WHEN station % 4 = 0 THEN coalesce(rjb, -1) ELSE 5 END AS rjb, station % 4 = 0 AS refreshed FROM r
""")
def refreshed_rupture_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four distances worked out where one is missing; keys of what changed."""
    pairs, models, planes = _ruptures(spark, sf_dir)
    lacks = F.col("station") % 4 == 0
    flat = pairs.withColumns({c: F.when(lacks & F.lit(c in ("rrup", "rjb")), -1.0).when(~lacks, 5.0) for c in maintenance.DISTANCES})
    done, changed = maintenance.refresh_distances(flat, models, planes)
    marked = done.join(changed.select("event", "station", F.lit(True).alias("refreshed")), ["event", "station"], "left")
    return _rounded(marked.select("event", "station", *maintenance.DISTANCES, F.coalesce("refreshed", F.lit(False)).alias("refreshed")), *maintenance.DISTANCES, digits=4)


@query(f"""
WITH r AS ({geodesy.RUPTURE}) SELECT event, station, method, rhypo, repi, rrup, rjb FROM r WHERE method <> 'finite fault model required'
""")
def distance_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of whole files by kind of rupture: points, models, planes, each worked out alone."""
    pairs, models, planes = _ruptures(spark, sf_dir)
    extended = pairs.where(f"magnitude >= {rupture.EXTENDED}")
    found = {
        "point": rupture.point_lists(pairs), "model": rupture.model_lists(extended, models),
        "plane": rupture.plane_lists(extended.join(models.select("event"), "event", "left_anti"), planes),
    }
    named = [df.withColumn("method", F.lit(method)) for method, df in found.items()]
    columns_ = [F.round(F.col("distances")[k], 4).alias(n) for k, n in enumerate(maintenance.DISTANCES)]
    return named[0].unionByName(named[1]).unionByName(named[2]).select("event", "station", "method", *columns_)


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, vec_id % 3 = 0 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS ready FROM embeddings)
SELECT vec_id, ready OR vec_id % 5 = 0 AS corrected, CASE WHEN ready THEN 16 END AS p_wave, CASE WHEN ready THEN 'now' ELSE 'before' END AS updated,
       CASE WHEN ready THEN round(list_sum(x) - len(x) * list_sum(x[1:16]) / 16, 6) ELSE 0 END AS total_1, CASE WHEN vec_id % 2 = 0 THEN CASE WHEN ready THEN len(x) ELSE 0 END END AS samples_3 FROM e
""")
def corrected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records that are not corrected yet, less the mean before their arrival; their states say so."""
    none = F.array().cast("array<double>")
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", *[_record().alias(f"uncorrected_{k}") for k in (1, 2)], F.when(F.col("vec_id") % 2 == 0, _record()).alias("uncorrected_3"), *[none.alias(f"corrected_{k}") for k in (1, 2)],
        F.when(F.col("vec_id") % 2 == 0, none).alias("corrected_3"), F.when(F.col("vec_id") % 3 == 0, "VALID").otherwise("PENDING").alias("status"), F.when(F.col("vec_id") % 5 == 0, True).alias("corrected"),
        F.when(F.col("vec_id") % 7 != 0, 16).alias("position"), F.lit(None).cast("int").alias("p_wave"), F.lit("before").alias("last_update"), F.lit("before").alias("updated"),
    )

    def flattened(values: Column, position: Column) -> Column:
        mean = F.aggregate(F.slice(values, 1, position), F.lit(0.0), lambda s, v: s + v) / F.nullif(position, F.lit(0))
        return F.element_at(F.transform(F.array(mean), lambda m: F.transform(values, lambda v: v - m)), 1)

    made = maintenance.correct_components(rows, flattened, F.lit("now"))
    total = F.round(F.aggregate("corrected_1", F.lit(0.0), lambda s, v: s + v), 6)
    return made.select("vec_id", "corrected", "p_wave", "updated", total.alias("total_1"), F.when(F.col("corrected_3").isNotNull(), F.size("corrected_3")).cast("long").alias("samples_3"))


def _plane(x: str, lon: str, lat: str) -> str:
    return f"6378137.0 * radians({lon}) AS {x}x, 6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2)) AS {x}y"


@query(f"""
WITH h AS (SELECT n_nationkey AS event, {_plane("h", "(-70.0 - n_nationkey / 10)", "(-20.0 - n_nationkey)")} FROM nation),
s AS (SELECT c_nationkey AS event, {_plane("s", "(-70.0 - c_custkey % 30 / 10)", "(-20.0 - c_custkey % 250 / 10)")} FROM customer),
c AS (SELECT n_nationkey AS event, k, {_plane("c", "(-70.0 - n_nationkey / 10 + dx + k)", "(-20.0 - n_nationkey + dy)")} FROM nation, (VALUES (0), (1)) p(k), (VALUES (-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2), (-0.2, -0.2)) q(dx, dy) WHERE n_nationkey % 3 = 0),
a AS (SELECT event, hx AS x, hy AS y FROM h UNION ALL SELECT event, sx, sy FROM s UNION ALL SELECT event, cx, cy FROM c),
b AS (SELECT event, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, greatest(max(x) - min(x), max(y) - min(y)) / 2 + 30000 AS d FROM a GROUP BY 1)
SELECT b.event, round(hx, 2) AS x, round(hy, 2) AS y, round(mx - d, 2) AS xmin, round(mx + d, 2) AS xmax, round(my - d, 2) AS ymin, round(my + d, 2) AS ymax,
       (SELECT count(*) FROM s WHERE s.event = b.event) AS stations, CASE WHEN b.event % 3 = 0 THEN 1.5 END::DOUBLE AS low, CASE WHEN b.event % 3 = 0 THEN 2.5 END::DOUBLE AS high,
       CASE WHEN b.event % 3 = 0 THEN 2 ELSE 0 END AS patches, coalesce((SELECT round(sum(cx) + sum(cy), 1) FROM c WHERE c.event = b.event), 0) AS corners
FROM b JOIN h USING (event)
""")
def map_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the map of each event shows: bounds, stations, and the patches of its rupture in the plane."""
    event, key = F.col("n_nationkey"), F.col("c_custkey")
    places = _table(spark, sf_dir, "nation").select(event.alias("event"), (-20.0 - event).alias("latitude"), (-70.0 - event / 10).alias("longitude"))
    stations = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("event"), (-20.0 - key % 250 / 10).alias("latitude"), (-70.0 - key % 30 / 10).alias("longitude"))
    edge = ((-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2), (-0.2, -0.2))
    patch = lambda k: F.struct(F.lit(1.5 + k).alias("slip"), F.array(*[F.struct((F.col("longitude") + a + k).alias("lon"), (F.col("latitude") + b).alias("lat"), F.lit(2000.0).alias("depth_m")) for a, b in edge]).alias("ring"))
    models = places.where("event % 3 = 0").select("event", F.explode(F.array(patch(0), patch(1))).alias("p")).select("event", "p.*")
    made = maintenance.map_payload(places, stations, models)
    corners = F.aggregate(F.flatten(F.transform("polygons", lambda p: p["ring"])), F.lit(0.0), lambda s, q: s + q["x"] + q["y"])
    rounded = _rounded(made, "x", "y", "xmin", "xmax", "ymin", "ymax", digits=2)
    return rounded.select("event", "x", "y", "xmin", "xmax", "ymin", "ymax", "stations", "low", "high", F.size("polygons").alias("patches"), F.round(corners, 1).alias("corners"))
