"""Queries over series of any length, random columns and the SQL surface, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import draws, registry
from tremorlake.operators import peaks, scans, signals
from tremorlake.plans.catalog import DT, ORACLES, ORDER, _rounded, _series, _table, query

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.in_blocks(_series(spark, sf_dir), ["user_id"], ORDER)


@query(ORACLES["motion_integrals"])
def integrals_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`motion_integrals` for records of any length: sums are carried from block to block."""
    flat = scans.remove_first_mean(_blocks(spark, sf_dir), "value", 10)
    v = F.col("value")
    made = scans.integrate(flat, {"velocity": v, "energy": v * v, "cav": F.abs(v)}, DT)
    made = made.withColumns({"arias": F.col("energy") * (math.pi / (2 * signals.GRAVITY)), "energy_share": F.col("energy") / F.nullif("energy_whole", F.lit(0.0))})
    names = ("velocity", "arias", "cav", "energy_share")
    return _rounded(made.select("event_id", *names), *names)


@query(ORACLES["moving_statistics"])
def statistics_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`moving_statistics` for records of any length: a block has the rows next to it at hand."""
    made = scans.moving_statistics(_blocks(spark, sf_dir), "value", 11, "mean", "deviation")
    return made.select("event_id", F.round("mean", 6).alias("mean"), F.round("deviation", 5).alias("deviation"))


@query(ORACLES["interpolated_values"])
def interpolated_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`interpolated_values` for records of any length: known values are carried from both sides."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), F.when(F.col("event_type") == "click", F.col("value")).alias("y"))
    made = scans.interpolate(scans.in_blocks(rows, ["user_id"], ["x"]), "x", "y")
    return _rounded(made.select("x", "y"), "y", digits=4)


_UNIFORM = "(('0x' || substr(md5('{seed}:' || {key}), {at}, 13))::BIGINT / pow(2, 52))"
_OF_ROW = "user_id || ':' || event_id"


@query(f"""
WITH u AS (SELECT event_id, {_UNIFORM.format(seed=11, key=_OF_ROW, at=1)} AS a, {_UNIFORM.format(seed=11, key=_OF_ROW, at=14)} AS b FROM events)
SELECT event_id, a AS uniform, round(sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b), 9) AS normal, (5 + floor(a * 20))::BIGINT AS number,
       CASE WHEN a * 10 < 1 THEN 'birth' WHEN a * 10 < 2 THEN 'death' ELSE 'move' END AS step FROM u
""")
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random numbers of each row by seed, key and index, the same in every run."""
    parts = [F.col("user_id"), F.col("event_id")]
    return _table(spark, sf_dir, "events").select(
        "event_id", draws.uniform(11, *parts).alias("uniform"), F.round(draws.normal(11, *parts), 9).alias("normal"),
        draws.integer(11, 5, 25, *parts).alias("number"), draws.choice(11, {"birth": 1, "death": 1, "move": 8}, *parts).alias("step"),
    )


@query(f"""
WITH z AS (SELECT event_id, user_id, ts, value / 100 - {_UNIFORM.format(seed=3, key=_OF_ROW, at=1)} AS d FROM events),
s AS (SELECT event_id, sum(d * d) OVER w AS s, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
SELECT event_id, CASE WHEN n = 20 THEN round(1 / sqrt(s / 19), 6) END AS likeness FROM s
""")
def noise_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each stretch of 20 samples is to a stretch of noise, the inverse of their distance."""
    rows = _series(spark, sf_dir).withColumns({"value": F.col("value") / 100, "noise": draws.uniform(3, F.col("user_id"), F.col("event_id"))})
    made = scans.sliding_likeness(scans.in_blocks(rows, ["user_id"], ORDER), "value", "noise", 20, "likeness")
    return _rounded(made.select("event_id", "likeness"), "likeness")


@query(f"""
WITH RECURSIVE n AS (SELECT user_id, row_number() {_W} - 1 AS i, floor(value / 10) AS v FROM events),
r AS (SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY user_id ORDER BY i) AS starts FROM n),
p AS (SELECT user_id, i, v, lag(v) OVER w AS before, lead(v) OVER w AS after, lead(i) OVER w AS stop FROM r WHERE starts WINDOW w AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT user_id, (i + stop - 1) // 2 AS place, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, i DESC) AS k FROM p WHERE v > before AND v > after),
g AS (
    SELECT user_id, 1 AS k, [place] AS kept FROM c WHERE k = 1
    UNION ALL
    SELECT g.user_id, c.k, CASE WHEN len(list_filter(kept, lambda q: abs(q - place) < 12)) = 0 THEN list_append(kept, place) ELSE kept END FROM g JOIN c ON c.user_id = g.user_id AND c.k = g.k + 1
),
f AS (SELECT user_id, unnest(arg_max(kept, k)) AS place FROM g GROUP BY 1)
SELECT f.user_id, f.place, n.v AS height FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.place
""")
def spaced_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each record in steps of 10, with many ties, at least 12 samples apart."""
    numbered = _blocks(spark, sf_dir).select("user_id", F.col(scans.PLACE).alias("place"), F.floor(F.col("value") / 10).cast("double").alias("v"))
    return peaks.find_peaks(numbered, ["user_id"], "place", "v", 12)


@query(f"""
WITH n AS (SELECT *, row_number() {_W} - 1 AS i FROM events),
s AS (SELECT user_id, i, sum(area) OVER (PARTITION BY user_id ORDER BY i) AS e FROM (SELECT *, coalesce((value * value + lag(value * value) {_W}) / 2 * {DT}, 0) AS area FROM n)),
h AS (SELECT user_id, i, e / nullif(max(e) OVER (PARTITION BY user_id), 0) AS share FROM s)
SELECT user_id, k::INT AS decile, arg_min(i, abs(share - k / 10.0::DOUBLE)) AS place FROM (SELECT * FROM h ORDER BY user_id, i), range(1, 11) r(k) GROUP BY 1, 2
""")
def energy_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples at which a record has a tenth, two tenths, ... of its energy."""
    made = scans.integrate(_blocks(spark, sf_dir), {"energy": F.col("value") * F.col("value")}, DT)
    shared = made.withColumn("share", F.col("energy") / F.nullif("energy_whole", F.lit(0.0)))
    found = scans.nearest_shares(shared, "share", ["user_id"])
    return found.select("user_id", F.posexplode("places").alias("k", "place")).select("user_id", (F.col("k") + 1).alias("decile"), F.col("place").cast("long").alias("place"))


@query(ORACLES["response_spectrum"])
def spectra_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of all records by a table function in a lateral join."""
    registry.register_functions(spark)
    return spark.sql(f"""
        SELECT vec_id, s.period, round(s.sa, 6) AS sa FROM parquet.`{sf_dir}/embeddings.parquet`,
        LATERAL spectrum_of(transform(embedding, x -> double(x)), {DT}D, array(0D, 0.05D, 0.2D, 1D), 0.05D) AS s""")


@query("""
WITH p AS (SELECT c_custkey, radians(-(c_custkey % 60) - 0.5) AS f, radians(-(c_nationkey + 60.25)) AS l, (c_custkey % 100)::DOUBLE AS h, c_nationkey, c_custkey % 25 AS m FROM customer),
d AS (SELECT *, 6378.137 * (1 - 1 / 298.257223563) AS b, 6378.137 AS a FROM p),
e AS (SELECT *, sqrt(a * a * pow(cos(f), 2) + b * b * pow(sin(f), 2)) AS r, sqrt(a * a * pow(cos(radians(-33.4)), 2) + b * b * pow(sin(radians(-33.4)), 2)) AS q FROM d)
SELECT c_custkey, round(sqrt(pow((a * a / r - h) * cos(f) * cos(l) - a * a / q * cos(radians(-33.4)) * cos(radians(-70.6)), 2)
    + pow((a * a / r - h) * cos(f) * sin(l) - a * a / q * cos(radians(-33.4)) * sin(radians(-70.6)), 2) + pow((b * b / r - h) * sin(f) - b * b / q * sin(radians(-33.4)), 2)), 5) AS rhypo,
    round(6378137.0 * l, 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + f / 2)), 3) AS y, abs(c_nationkey - 12.25) + abs(m - 12.25) < 8.1 AS inside,
    round(pow(10, -2.9 + 0.63 * (c_custkey % 9)), 6) AS fault_length FROM e
""")
def distances_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, map coordinates, a polygon and the size of a fault by functions in SQL."""
    registry.register_functions(spark)
    ring = ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in [(12.25, 4.15), (20.35, 12.25), (12.25, 20.35), (4.15, 12.25)])
    return spark.sql(f"""
        SELECT c_custkey, round(hypocentral_km(lat, lon, double(c_custkey % 100), -33.4D, -70.6D), 5) AS rhypo, round(mercator(lon, lat).x, 3) AS x, round(mercator(lon, lat).y, 3) AS y,
               in_polygon(double(c_nationkey), double(c_custkey % 25), array({ring})) AS inside, round(fault_km(double(c_custkey % 9)).length, 6) AS fault_length
        FROM (SELECT *, -(c_custkey % 60) - 0.5D AS lat, -(c_nationkey + 60.25D) AS lon FROM parquet.`{sf_dir}/customer.parquet`)""")
