"""All queries of the library by name, with the SQL that gives the same rows.

The tables of the driver stand in for catalogues (`orders`), stations (`customer`), series
(`events`, by user and time) and records (`embeddings`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.functions import columns, geo
from tremorlake.operators import correction, picker, relations, rupture, sampler, signals, spectra
from tremorlake.plans import geodesy

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DT = 0.01
#: Periods and dampings of the table of spectral values.
PERIODS = [
    0.0, 0.01, 0.02, 0.022, 0.025, 0.029, 0.03, 0.032, 0.035, 0.036, 0.04, 0.042, 0.044, 0.045, 0.046, 0.048, 0.05, 0.055, 0.06, 0.065,
    0.067, 0.07, 0.075, 0.08, 0.085, 0.09, 0.095, 0.1, 0.11, 0.12, 0.13, 0.133, 0.14, 0.15, 0.16, 0.17, 0.18, 0.19, 0.2, 0.22,
    0.24, 0.25, 0.26, 0.28, 0.29, 0.3, 0.32, 0.34, 0.35, 0.36, 0.38, 0.4, 0.42, 0.44, 0.45, 0.46, 0.48, 0.5, 0.55, 0.6,
    0.65, 0.667, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0, 2.2,
    2.4, 2.5, 2.6, 2.8, 3.0, 3.2, 3.4, 3.5, 3.6, 3.8, 4.0, 4.2, 4.4, 4.6, 4.8, 5.0, 5.5, 6.0, 6.5, 7.0,
    7.5, 8.0, 8.5, 9.0, 9.5, 10.0,
]
DAMPINGS = [0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("event"), (F.col("o_totalprice") / 1e5).alias("magnitude"), F.col("o_orderdate").alias("updated"),
        F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("station"),
    )


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""
SELECT o_custkey AS event, max(o_orderdate) AS updated, count(*) AS n FROM orders
WHERE o_totalprice / 1e5 BETWEEN 1.0 AND 4.0 AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1998-12-31' AND lower(o_orderpriority) = '1-urgent'
GROUP BY o_custkey ORDER BY updated DESC, event
""")
def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = tuple(F.lit(d).cast("timestamp_ntz") for d in ("1993-01-01", "1998-12-31"))
    found = relations.filter_catalogue(_catalogue(spark, sf_dir), {"magnitude": (1.0, 4.0), "updated": dates}, {"type": "1-Urgent", "station": "Any"})
    return found.groupBy("event").agg(F.max("updated").alias("updated"), F.count("*").alias("n")).orderBy(F.desc("updated"), "event")


@query("""
SELECT o_orderpriority AS type, upper(left(o_orderpriority, 1)) || lower(substr(o_orderpriority, 2)) AS label, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
       min(o_totalprice / 1e5) AS low, max(o_totalprice / 1e5) AS high FROM orders GROUP BY 1, 2 ORDER BY 1
""")
def catalogue_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalogue(spark, sf_dir).groupBy("type").agg(F.min("updated").alias("first_date"), F.max("updated").alias("last_date"), F.min("magnitude").alias("low"), F.max("magnitude").alias("high"))
    return found.withColumn("label", columns.capitalised(F.col("type"))).orderBy("type")


@query("""
SELECT 'c' AS source, c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 's', s_suppkey, s_name, NULL FROM supplier
""")
def catalogue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    second = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name")
    return relations.union_catalogues({"c": first, "s": second}, "source")


@query("""
WITH e AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y%m%d') || '_' || CASE WHEN o_orderkey % 7 = 0 THEN 'magM' ELSE (o_orderkey % 10) || '.5M' END
    || '_' || (o_custkey % 90) || 'S_' || (o_custkey % 180) || 'W_depthKM' AS id FROM orders)
SELECT o_orderkey, id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 10 + 0.5 END::DOUBLE AS magnitude,
       -CAST(replace(split_part(id, '_', 3), 'S', '') AS DOUBLE) AS latitude, NULL::DOUBLE AS depth FROM e
""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    text = lambda e: F.expr(f"cast({e} AS string)")
    magnitude = F.when(F.expr("o_orderkey % 7 <> 0"), F.concat(text("o_orderkey % 10"), F.lit(".5")))
    made = orders.withColumn("id", columns.event_id(F.col("o_orderdate"), magnitude, text("o_custkey % 90"), text("o_custkey % 180"), F.lit(None).cast("string")))
    parts = columns.parsed_event_id(F.col("id"))
    return made.select("o_orderkey", "id", *[parts[c].alias(c) for c in ("date", "magnitude", "latitude", "depth")])


@query("""
WITH now AS (SELECT o_custkey AS event, o_orderpriority AS station, max(o_orderdate) AS updated FROM orders GROUP BY 1, 2),
seen AS (SELECT o_custkey AS event, o_orderpriority AS station, max(o_orderdate) AS updated FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2)
SELECT n.event, n.station, n.updated FROM now n LEFT JOIN seen s USING (event, station) WHERE s.event IS NULL OR n.updated IS DISTINCT FROM s.updated
""")
def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = lambda df: df.groupBy("event", F.col("type").alias("station")).agg(F.max("updated").alias("updated"))
    events = _catalogue(spark, sf_dir)
    return relations.new_or_changed(latest(events), latest(events.where("station <> 'O'")), ["event", "station"], "updated")


@query("SELECT o_custkey, o_orderpriority FROM orders GROUP BY 1, 2 HAVING count(*) = 1")
def unrepeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.drop_all_copies(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("""
WITH new AS (SELECT c_custkey, c_acctbal + 1 AS balance FROM customer WHERE c_acctbal < 0)
SELECT * FROM new UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)
""")
def draft_over_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal AS balance")
    return relations.upsert(main, main.where("balance < 0").withColumn("balance", F.col("balance") + 1), ["c_custkey"])


@query("""
WITH o AS (SELECT o_custkey AS event, list_distinct(list(o_orderpriority)) AS l FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
f AS (SELECT o_custkey AS event, list_distinct(list(o_orderpriority)) AS l FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT event, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.l, []), coalesce(f.l, [])))), '; ') AS stations FROM o FULL JOIN f USING (event)
""")
def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _catalogue(spark, sf_dir)
    packed = lambda df: df.groupBy("event").agg(F.array_join(F.array_sort(F.collect_set("type")), "; ").alias("stations"))
    return relations.merge_lists(packed(events.where("station = 'O'")), packed(events.where("station <> 'O'")), "event", "stations")


@query("""
SELECT o_orderkey, coalesce(c_name, 'Unknown') AS station, nullif(c_nationkey, 0) AS vs30, coalesce(c_acctbal, -1) AS distance
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0
""")
def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = _table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    joined = _table(spark, sf_dir, "orders").join(stations, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        "o_orderkey", F.coalesce("c_name", F.lit("Unknown")).alias("station"), columns.falsy_to_null(F.col("c_nationkey")).alias("vs30"),
        columns.number_or_sentinel(F.col("c_acctbal").cast("string")).alias("distance"),
    )


@query("""
SELECT event_type AS status, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50) AS high FROM events
WHERE event_type IN ('click', 'view', 'purchase') OR event_type IS NULL GROUP BY 1
""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    wanted = columns.any_of([F.col("event_type").isin("click", "view", "purchase"), F.col("event_type").isNull()])
    return events.where(wanted).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("k") > 50).alias("high"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


ORDER = ["ts", "event_id"]
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""
WITH n AS (SELECT *, row_number() {_W} AS i FROM events),
d AS (SELECT *, value - coalesce(avg(value) FILTER (WHERE i <= 10) OVER (PARTITION BY user_id), 0) AS a FROM n),
s AS (SELECT *, coalesce((a + lag(a) {_W}) / 2 * {DT}, 0) AS area, coalesce((a * a + lag(a * a) {_W}) / 2 * {DT}, 0) AS sq,
             coalesce((abs(a) + lag(abs(a)) {_W}) / 2 * {DT}, 0) AS ab FROM d),
e AS (SELECT *, sum(area) {_W} AS v, sum(sq) {_W} AS e, sum(ab) {_W} AS c FROM s)
SELECT event_id, round(v, 6) AS velocity, round(e * pi() / (2 * {signals.GRAVITY}), 6) AS arias, round(c, 6) AS cav,
       round(e / nullif(max(e) OVER (PARTITION BY user_id), 0), 6) AS energy_share FROM e
""")
def motion_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = signals.remove_first_mean(_series(spark, sf_dir), "value", 10, ["user_id"], ORDER)
    moved = signals.integrate(base, "value", "velocity", DT, ["user_id"], ORDER)
    found = signals.intensity(moved, "value", DT, ["user_id"], ORDER)
    names = ("velocity", "arias", "cav", "energy_share")
    return _rounded(found.select("event_id", *names), *names)


@query(f"""
WITH m AS (SELECT event_id, sum(value) OVER w / 11 AS a, sum(value * value) OVER w / 11 AS b FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT event_id, round(a, 6) AS mean, round(sqrt(greatest(b - a * a, 0)), 5) AS deviation FROM m
""")
def moving_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return _series(spark, sf_dir).select(
        "event_id", F.round(signals.moving_average(value, 11, ["user_id"], ORDER), 6).alias("mean"), F.round(signals.moving_deviation(value, 11, ["user_id"], ORDER), 5).alias("deviation")
    )


@query(f"""
SELECT event_id, round(CASE WHEN lag(value) {_W} IS NULL THEN (-3 * value + 4 * lead(value) {_W} - lead(value, 2) {_W}) / {2 * DT}
    WHEN lead(value) {_W} IS NULL THEN (3 * value - 4 * lag(value) {_W} + lag(value, 2) {_W}) / {2 * DT}
    ELSE (lead(value) {_W} - lag(value) {_W}) / {2 * DT} END, 4) AS slope FROM events
""")
def value_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope = signals.gradient(F.col("value"), DT, signals.ordered(["user_id"], ORDER))
    return _series(spark, sf_dir).select("event_id", F.round(slope, 4).alias("slope"))


@query("""
WITH k AS (SELECT user_id, event_id AS x, CASE WHEN event_type = 'click' THEN value END AS y FROM events),
b AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN x END) OVER (PARTITION BY user_id ORDER BY x) AS xa,
             min(CASE WHEN y IS NOT NULL THEN x END) OVER (PARTITION BY user_id ORDER BY x DESC) AS xb FROM k)
SELECT b.x, round(CASE WHEN b.y IS NOT NULL THEN b.y WHEN l.y IS NULL THEN r.y WHEN r.y IS NULL THEN l.y ELSE l.y + (r.y - l.y) * (b.x - b.xa) / (b.xb - b.xa) END, 4) AS y
FROM b LEFT JOIN k l ON l.x = b.xa LEFT JOIN k r ON r.x = b.xb
""")
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), F.when(F.col("event_type") == "click", F.col("value")).alias("y"))
    return _rounded(signals.interpolate(rows, "x", "y", ["user_id"]).select("x", "y"), "y", digits=4)


def _record(c: Column | str = "embedding") -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda v: v.cast("double"))


@query("""
WITH RECURSIVE p(t) AS (VALUES (0.05::DOUBLE), (0.2), (1.0)),
c AS (SELECT t, 2 * pi() / t AS w, 1 + 0.05 * (2 * pi() / t) * 0.01 + pow(2 * pi() / t, 2) * 0.0001 / 4 AS a1, 0.05 * (2 * pi() / t) * 0.01 + pow(2 * pi() / t, 2) * 0.0001 / 4 AS a2,
             2 * 0.05 * (2 * pi() / t) + pow(2 * pi() / t, 2) * 0.01 AS a3 FROM p),
s AS (
    SELECT vec_id, t, 1 AS j, 0::DOUBLE AS u, 0::DOUBLE AS v, -(embedding[1]::DOUBLE) AS a, 0::DOUBLE AS peak FROM embeddings, c
    UNION ALL
    SELECT vec_id, t, j + 1, u + v * 0.01 + 0.0001 / 4 * (a + n), v + 0.01 / 2 * (a + n), n, greatest(peak, abs(u + v * 0.01 + 0.0001 / 4 * (a + n)))
    FROM (SELECT s.*, (-(e.embedding[s.j + 1]::DOUBLE) - s.a * c.a2 - s.v * c.a3 - s.u * c.w * c.w) / c.a1 AS n FROM s JOIN c USING (t) JOIN embeddings e USING (vec_id) WHERE s.j < len(e.embedding))
)
SELECT vec_id, t AS period, round(pow(2 * pi() / t, 2) * max(peak), 6) AS sa FROM s GROUP BY 1, 2
UNION ALL SELECT vec_id, 0::DOUBLE, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) FROM embeddings
""")
def response_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = [0.0, 0.05, 0.2, 1.0]
    made = _table(spark, sf_dir, "embeddings").withColumn("sa", spectra.response_spectrum(_record(), DT, periods, 0.05))
    rows = made.select("vec_id", F.posexplode("sa").alias("k", "sa"))
    return rows.select("vec_id", F.get(F.array(*map(F.lit, periods)), F.col("k")).alias("period"), F.round("sa", 6).alias("sa"))


@query()
def rotated_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated spectra at all periods and dampings of the table, all oscillators of a record in one pass."""
    rows = _spread(spark, sf_dir).select("vec_id", _record().alias("x"), F.reverse(_record()).alias("y"), F.lit(None).cast("array<double>").alias("z"))
    made = spectra.spectral_batch(rows, ["vec_id"], ["x", "y", "z"], DT, PERIODS, DAMPINGS, 181)
    return made.select("vec_id", "damping", "period", "rotd0", "rotd50", "rotd100", "geometric_mean")


@query("""
WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n, len(embedding) AS l FROM embeddings),
f AS (SELECT vec_id, k, l, 2 * 0.01 * sqrt(pow(sum(x * cos(2 * pi() * k * n / l)), 2) + pow(sum(x * sin(2 * pi() * k * n / l)), 2)) AS a
      FROM s, range(0, 32) r(k) WHERE k < l // 2 GROUP BY vec_id, k, l)
SELECT vec_id, k::INT AS k, round(k * ((l // 2)::DOUBLE / (l // 2 - 1)) / (l * 0.01), 6) AS frequency, round(a, 6) AS amplitude FROM f
""")
def fourier_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(spectra.fourier_amplitude(_record(), DT)).alias("k", "s"))
    return made.select("vec_id", "k", F.round("s.frequency", 6).alias("frequency"), F.round("s.amplitude", 6).alias("amplitude"))


@query("""
WITH p AS (SELECT c_custkey, radians(-(c_custkey % 60) - 0.5) AS f, radians(-(c_nationkey + 60.25)) AS l, (c_custkey % 100)::DOUBLE AS h FROM customer),
d AS (SELECT *, 6378.137 * (1 - 1 / 298.257223563) AS b, 6378.137 AS a FROM p),
e AS (SELECT *, sqrt(a * a * pow(cos(f), 2) + b * b * pow(sin(f), 2)) AS r, sqrt(a * a * pow(cos(radians(-33.4)), 2) + b * b * pow(sin(radians(-33.4)), 2)) AS q FROM d)
SELECT c_custkey, round(sqrt(pow((a * a / r - h) * cos(f) * cos(l) - a * a / q * cos(radians(-33.4)) * cos(radians(-70.6)), 2)
    + pow((a * a / r - h) * cos(f) * sin(l) - a * a / q * cos(radians(-33.4)) * sin(radians(-70.6)), 2) + pow((b * b / r - h) * sin(f) - b * b / q * sin(radians(-33.4)), 2)), 5) AS rhypo,
    round(6378137.0 * l, 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + f / 2)), 3) AS y FROM e
""")
def hypocentral_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "-(c_custkey % 60) - 0.5D AS lat", "-(c_nationkey + 60.25D) AS lon", "double(c_custkey % 100) AS depth")
    here = geo.ecef(F.col("lat"), F.col("lon"), F.col("depth"))
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    there = geo.ecef(F.lit(-33.4), F.lit(-70.6), F.lit(0.0))
    return rows.select("c_custkey", F.round(geo.straight_distance(here, there), 5).alias("rhypo"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(geodesy.EPICENTRAL)
def epicentral_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "-(c_custkey % 60) - 0.5D AS lat", "-(c_nationkey + 60.25D) AS lon")
    return rows.select("c_custkey", F.round(geo.geodesic_km(F.col("lat"), F.col("lon"), F.lit(-33.4), F.lit(-70.6)), 5).alias("repi"))


@query("""
WITH g AS (SELECT s_suppkey, s_nationkey::DOUBLE AS gx, (s_suppkey % 10)::DOUBLE AS gy, -s_acctbal / 100 AS dep FROM supplier WHERE s_acctbal > 0),
j AS (SELECT c_custkey, c_custkey % 60 AS depth, dep, row_number() OVER (PARTITION BY c_custkey ORDER BY pow(gx - c_nationkey, 2) + pow(gy - c_custkey % 10, 2), s_suppkey) AS k FROM customer, g)
SELECT c_custkey, CASE WHEN -dep - depth > 10 THEN 'crustal' WHEN -dep - depth >= -10 THEN 'interface' ELSE 'intraslab' END AS event_type FROM j WHERE k = 1
""")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey", "double(s_nationkey) AS gx", "double(s_suppkey % 10) AS gy", "-s_acctbal / 100 AS dep")
    events = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", "c_custkey % 60 AS depth", "c_custkey % 10 AS cy")
    best = relations.nearest_in_plane(events, grid, "c_custkey", ("c_nationkey", "cy"), ("gx", "gy"), ["dep"], "s_suppkey")
    gap = -F.col("dep") - F.col("depth")
    kind = F.when(gap > 10, "crustal").when(gap >= -10, "interface").when(gap.isNotNull(), "intraslab").otherwise("undetermined")
    return events.join(best, "c_custkey", "left").select("c_custkey", kind.alias("event_type"))


@query("SELECT c_custkey, abs(c_nationkey - 12.25) + abs(c_custkey % 25 - 12.25) < 8.1 AS inside FROM customer")
def stations_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [(12.25, 4.15), (20.35, 12.25), (12.25, 20.35), (4.15, 12.25)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return _table(spark, sf_dir, "customer").select("c_custkey", geo.in_polygon(F.col("c_nationkey").cast("double"), F.expr("double(c_custkey % 25)"), ring).alias("inside"))


@query("""
WITH b AS (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN b USING (l_orderkey) WHERE l_quantity >= lo + 0.15 * (hi - lo)
""")
def slip_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = Window.partitionBy("l_orderkey")
    low, high = F.min("l_quantity").over(event), F.max("l_quantity").over(event)
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (low + 0.15 * (high - low)).alias("cut"))
    return rows.where("l_quantity >= cut").drop("cut")


@query("SELECT user_id, min(value) AS rotd0, round(median(value), 6) AS rotd50, max(value) AS rotd100, round(sqrt(abs(min(value) * max(value))), 6) AS geometric_mean FROM events GROUP BY 1")
def rotd_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _series(spark, sf_dir).groupBy("user_id").agg(F.min("value").alias("rotd0"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("rotd50"), F.max("value").alias("rotd100"))
    return found.withColumn("geometric_mean", F.round(F.sqrt(F.abs(F.col("rotd0") * F.col("rotd100"))), 6))


@query("""
WITH h AS (SELECT least(floor(l_quantity / 5.0), 9)::BIGINT AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
SELECT r.k AS bin, r.k * 5.0::DOUBLE + 2.5 AS centre, count(h.bin) AS n FROM range(0, 10) r(k) LEFT JOIN h ON h.bin = r.k GROUP BY r.k
""")
def fixed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").where("l_quantity BETWEEN 0 AND 50")
    counts = rows.groupBy(F.least(F.floor(F.col("l_quantity") / 5.0), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", (F.col("bin") * 5.0 + 2.5).alias("centre"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS k FROM c),
b AS (SELECT l_suppkey, l_linenumber, l_extendedprice, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey) AS r FROM lineitem JOIN m USING (l_suppkey, l_linenumber) WHERE k = 1)
SELECT l_suppkey AS chain, l_linenumber AS partitions, l_extendedprice AS misfit, l_orderkey AS step FROM b WHERE r = 1
""")
def best_of_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<double>")
    history = _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("chain"), F.col("l_linenumber").alias("partitions"), F.col("l_extendedprice").alias("misfit"), F.col("l_orderkey").alias("step"), none.alias("xs"), none.alias("ys")
    )
    return sampler.best_of_mode(history, "chain", 0).drop("xs", "ys")


@query("SELECT l_returnflag AS process, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS accepted, count(*) FILTER (WHERE l_linestatus <> 'O') AS rejected FROM lineitem GROUP BY 1")
def move_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("l_linestatus") == "O"
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("process")).agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query("""
SELECT c_custkey, field, value FROM (SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer) UNPIVOT INCLUDE NULLS (value FOR field IN (name, nation, segment))
""")
def station_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name AS name", "string(c_nationkey) AS nation", "c_mktsegment AS segment")
    return rows.unpivot("c_custkey", ["name", "nation", "segment"], "field", "value")


@query("""
SELECT l_suppkey, round(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 4) AS p1, round(sum(l_quantity) FILTER (WHERE l_linenumber = 2), 4) AS p2, round(sum(l_quantity) FILTER (WHERE l_linenumber = 3), 4) AS p3,
       round(sum(l_quantity) FILTER (WHERE l_linenumber = 4), 4) AS p4, round(sum(l_quantity) FILTER (WHERE l_linenumber = 5), 4) AS p5, round(sum(l_quantity) FILTER (WHERE l_linenumber = 6), 4) AS p6,
       round(sum(l_quantity) FILTER (WHERE l_linenumber = 7), 4) AS p7 FROM lineitem GROUP BY 1
""")
def period_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", [*range(1, 8)]).agg(F.round(F.sum("l_quantity"), 4))
    return wide.toDF("l_suppkey", *[f"p{k}" for k in range(1, 8)])


@query("SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id) / 1024.0::DOUBLE AS kib FROM events")
def running_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running size of the files of each user."""
    running = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _table(spark, sf_dir, "events").select("event_id", (F.sum(F.length("props")).over(running) / 1024.0).alias("kib"))


@query(r"""
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="/([A-Za-z]+)"', 1))), '; ') AS stations FROM pages
""")
def scraped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]+)"'), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(found)), "; ").alias("stations"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / 9.81)), 6) AS total, len(embedding) + 16 AS samples, (0.01 * (len(embedding) + 15))::DOUBLE AS last_time FROM embeddings")
def aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), 8)
    padded = F.concat(zeros, F.transform(_record(), lambda v: v / signals.GRAVITY), zeros)
    times = F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: i * DT)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", padded.alias("a"))
    return rows.select("vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size("a").alias("samples"), F.element_at(times, -1).alias("last_time"))


@query()
def connected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of the mode for each user's series, after a whole chain of the operator."""
    rows = _series(spark, sf_dir).withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("s", F.lit(10.0))
    return sampler.connected_lines(rows, "user_id", "x", "value", "s", burn_in=200).select("user_id", "partitions", "step", "misfit")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over all tasks: a chain takes far more time than moving its record."""
    # A number of partitions is given, or else adaptive execution joins records of few bytes in one task.
    return _table(spark, sf_dir, "embeddings").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")


@query()
def arrival_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks in each vector taken as a record of 10 samples a second."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", _record().alias("v"))
    made = picker.pick_arrivals(rows, "vec_id", "v", 10.0)
    return made.select("vec_id", "position", "status", F.round(F.array_min("similarity"), 6).alias("least"))


@query()
def corrected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline correction of each vector with its arrival at sample 16, whole chains."""
    made = correction.correct_records(F.col("vec_id"), _record(), F.lit(DT), F.col("label") >= 0, F.lit(16))
    rows = _spread(spark, sf_dir).select("vec_id", made.alias("c"))
    peak = [F.round(F.array_max(F.transform(f"c.{k}", F.abs)), 6).alias(f"peak_{k}") for k in ("corrected", "filtered")]
    return rows.select("vec_id", F.size("c.corrected").alias("samples"), *peak, F.round("c.fmin", 6).alias("fmin"), F.round("c.fmax", 6).alias("fmax"))


def _ruptures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stations with their events, models and planes: customers as stations, nations as events; points, models of one ring, planes, and events with neither."""
    event = F.col("n_nationkey")
    events = _table(spark, sf_dir, "nation").select(
        event.alias("event"), (-20.0 - event).alias("latitude"), (-70.0 - event / 10).alias("longitude"),
        (20.0 + event).alias("depth"), F.when(event % 2 == 0, 6.5).otherwise(7.5).alias("magnitude"),
    )
    key = F.col("c_custkey")
    stations = _table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("event"), key.alias("station"), (-20.0 - key % 250 / 10).alias("station_lat"), (-70.0 - key % 30 / 10).alias("station_lon")
    )
    edge = ((-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2), (-0.2, -0.2))
    ring = F.array(*(F.struct((F.col("longitude") + a).alias("lon"), (F.col("latitude") + b).alias("lat"), F.lit(2000.0).alias("depth_m")) for a, b in edge))
    models = events.where("event % 3 = 0").select("event", F.lit(1.0).alias("slip"), ring.alias("ring"))
    planes = events.where("event % 3 = 1").select("event", F.lit(10.0).alias("strike"), F.lit(20.0).alias("dip"))
    return stations.join(events, "event"), models, planes


@query(geodesy.RUPTURE)
def rupture_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rupture.distances(*_ruptures(spark, sf_dir))
    return _rounded(found, "rhypo", "repi", "rrup", "rjb", digits=4)


@query("""
WITH d AS (SELECT l_orderkey, max(l_partkey * 100000 + l_suppkey) AS latest FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
w AS (SELECT DISTINCT l_orderkey, l_partkey % 1000 AS "position", CASE l_returnflag WHEN 'A' THEN 'VALID' ELSE 'DISCARDED' END AS status,
      CASE WHEN l_linestatus = 'O' THEN 'Manual' ELSE 'Automatic' END AS method
      FROM lineitem JOIN d USING (l_orderkey) WHERE l_returnflag <> 'N' AND l_partkey * 100000 + l_suppkey = latest)
SELECT coalesce(o_orderkey, l_orderkey) AS event, CASE WHEN l_orderkey IS NULL THEN -1 ELSE "position" END AS "position", coalesce(status, 'PENDING') AS status, method
FROM orders FULL JOIN w ON o_orderkey = l_orderkey
""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pending picks, returned lines as decisions; a line kept changes nothing."""
    none = F.lit(None).cast("string")
    state = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.lit(-1).cast("long").alias("position"), F.lit("PENDING").alias("status"), none.alias("method"))
    verdict = F.when(F.col("l_returnflag") == "A", "valid").when(F.col("l_returnflag") == "R", "discarded").otherwise("kept")
    made = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("at"),
        (F.col("l_partkey") % 1000).alias("position"), verdict.alias("verdict"), (F.col("l_linestatus") == "O").alias("moved"),
    )
    return relations.apply_decisions(state, made, ["event"], "at")
