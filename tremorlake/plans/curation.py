"""Queries of flat files, review states, record assembly and lookups, with the SQL that gives the same rows.

The tables of the driver stand in: `customer` for stations, `orders` for records and states, `lineitem`
for distances, `events` for series, `embeddings` for waveforms, `part` for channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.functions import columns, geo
from tremorlake.operators import curation, records, scans, signals, spectra
from tremorlake.plans.catalog import DAMPINGS, DT, ORDER, PERIODS, _record, _rounded, _series, _spread, _table, query


@query("""
SELECT event_id, s IS NULL AS pending, s IS NOT NULL AND s NOT IN ('true', 'false') AS postponed, coalesce(s = 'true', false) AND NOT coalesce(c, false) AS ready,
       coalesce(s <> 'false', false) AS shown, s IS NULL OR s NOT IN ('true', 'false') AS needs_download, coalesce(c, false) AS corrected
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' WHEN 'purchase' THEN NULL ELSE 'postponed' END AS s,
             CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c FROM events)
""")
def record_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' WHEN 'purchase' THEN NULL ELSE 'postponed' END AS s",
        "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c",
    )
    s, c = F.col("s"), F.col("c")
    return rows.select(
        "event_id", curation.is_pending(s).alias("pending"), curation.is_postponed(s).alias("postponed"), curation.ready_to_correct(s, c).alias("ready"),
        curation.is_shown(s).alias("shown"), curation.needs_download(s).alias("needs_download"), F.coalesce(c, F.lit(False)).alias("corrected"),
    )


@query("""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders JOIN (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS done FROM customer WHERE c_acctbal >= 0) r
ON o_custkey = c_custkey WHERE NOT coalesce(done, false)
""")
def untransformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered and not yet transformed, by an inner join with the three-valued registry."""
    registry = _table(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("c_custkey", "CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS done")
    joined = _table(spark, sf_dir, "orders").join(registry, F.col("o_custkey") == F.col("c_custkey"))
    return joined.where("NOT coalesce(done, false)").select("o_orderkey", "o_custkey", "o_orderdate")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE NOT (coalesce(l_quantity - 10 >= 0, false) AND coalesce(l_discount - 0.02 >= 0, false) AND coalesce(nullif(l_tax, 0.0) >= 0, false) AND coalesce(l_extendedprice >= 0, false))
AND nullif(l_partkey % 11, 0) IS NOT NULL AND nullif(l_suppkey % 7, 0) IS NOT NULL AND l_shipdate IS NOT NULL
""")
def distance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose distances are to be worked out anew."""
    known = [F.expr(e) for e in ("l_quantity - 10", "l_discount - 0.02D", "nullif(l_tax, 0.0D)", "l_extendedprice")]
    inputs = [F.expr(e) for e in ("nullif(l_partkey % 11, 0)", "nullif(l_suppkey % 7, 0)", "l_shipdate")]
    return _table(spark, sf_dir, "lineitem").where(curation.lacks_distances(known, inputs)).select("l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, CASE WHEN l_linenumber = 1 THEN 'required' WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity + (l_partkey % 3) * 1e-9 + (l_partkey % 2) AS VARCHAR) END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM p WHERE NOT coalesce(abs(a - CASE WHEN b IS NULL THEN NULL ELSE coalesce(TRY_CAST(b AS DOUBLE), -1) END) < 1e-8, false)
""")
def changed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn(
        "b", F.expr("CASE WHEN l_linenumber = 1 THEN 'required' WHEN l_linenumber = 2 THEN NULL ELSE cast(l_quantity + (l_partkey % 3) * 1e-9D + (l_partkey % 2) AS string) END")
    )
    return rows.where(curation.differs(F.col("l_quantity").cast("string"), F.col("b"))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring') OR contains(p_name, 'red')")
def affix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").where(name.startswith("small") | name.endswith("ring") | name.contains("red")).select("p_partkey", "p_name")


@query("""
WITH f AS (SELECT o_orderkey AS record, replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '' END AS start_text,
                  CASE WHEN o_orderkey % 5 = 0 THEN 'Finite fault model required' ELSE CAST(o_totalprice AS VARCHAR) END AS rrup, o_custkey AS station FROM orders)
SELECT record, station, CAST(replace(replace(start_text, 'T', ' '), 'Z', '') AS TIMESTAMP) AS start_time, CAST(left(start_text, 10) AS DATE) AS day, TRY_CAST(rrup AS DOUBLE) AS rrup,
       coalesce(TRY_CAST(rrup AS DOUBLE), -1) AS stored, row_number() OVER (ORDER BY record, station) - 1 AS number FROM f ORDER BY record, station
""")
def flat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fields cast to their types, sorted by the keys; times without `T` and `Z`."""
    text = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS record", "o_custkey AS station", "concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '' END) AS start_time",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'Finite fault model required' ELSE cast(o_totalprice AS string) END AS rrup",
    )
    text = text.withColumns({"day": F.substring("start_time", 1, 10), "stored": columns.number_or_sentinel(F.col("rrup"))})
    typed = curation.cast_block(text, ["rrup"], ["day"], ["start_time"]).orderBy("record", "station")
    # A number over a whole sorted file: it is given by partition, in the order of the sort.
    return _numbered(typed, ["record", "station"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds number, from 0 in the order of all rows: counted by ranges that are written once, so that no task sees all rows."""
    blocks = scans.in_blocks(rows, [], order)
    return scans.plain(blocks.withColumn("number", F.col(scans.PLACE))).orderBy(*order)


@query("""
WITH last AS (SELECT o_custkey, max(o_orderdate) AS updated FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, c_name, coalesce(updated, TIMESTAMP '1990-01-01') AS updated FROM customer LEFT JOIN last ON c_custkey = o_custkey
""")
def refreshed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("updated"))
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "TIMESTAMP_NTZ '1990-01-01' AS updated")
    return curation.refresh(rows, last, ["c_custkey"], ["updated"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _table(spark, sf_dir, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")
    return curation.delete_keys(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("""
WITH s AS (SELECT user_id % 10 AS event, event_type AS station, max(event_id) AS position FROM events GROUP BY 1, 2)
SELECT o_orderkey, coalesce(position, -1) AS position, position IS NOT NULL AS known
FROM (SELECT *, o_custkey % 12 AS event, ['click', 'view', 'purchase', 'none'][o_orderkey % 4 + 1] AS station FROM orders) LEFT JOIN s USING (event, station)
""")
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each (event, station); -1 where there is none."""
    state = _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("event"), F.col("event_type").alias("station")).agg(F.max("event_id").alias("position"))
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 12 AS event", "array('click', 'view', 'purchase', 'none')[int(o_orderkey % 4)] AS station")
    return rows.join(state, ["event", "station"], "left").select("o_orderkey", F.coalesce("position", F.lit(-1)).alias("position"), F.col("position").isNotNull().alias("known"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS member FROM customer")
def station_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that an event file holds already (semi join) and those that are new (anti join)."""
    stations = _table(spark, sf_dir, "customer").select("c_custkey")
    held = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    known, new = stations.join(held, "c_custkey", "left_semi"), stations.join(held, "c_custkey", "left_anti")
    return known.withColumn("member", F.lit(True)).unionByName(new.withColumn("member", F.lit(False)))


_KNOTS = "SELECT DISTINCT user_id, floor(event_id / 100.0)::BIGINT * 100 + 7 AS event_id FROM events WHERE event_type = 'click'"


@query(f"""
WITH k AS ({_KNOTS}) SELECT e.event_id, max(k.event_id) AS boundary FROM events e LEFT JOIN k ON k.user_id = e.user_id AND k.event_id <= e.event_id GROUP BY e.event_id
""")
def last_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last boundary at or before each sample, within a record."""
    samples = _table(spark, sf_dir, "events").select("user_id", "event_id")
    knots = _table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id", "floor(event_id / 100.0) * 100 + 7 AS event_id").distinct().withColumn("boundary", F.col("event_id"))
    return curation.as_of(samples, knots, "user_id", "event_id", ["boundary"]).select("event_id", "boundary")


@query(f"""
WITH k AS ({_KNOTS}), s AS (SELECT user_id, event_id AS low, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS high FROM k)
SELECT e.event_id, s.low, s.high FROM events e JOIN s ON s.user_id = e.user_id AND e.event_id BETWEEN s.low AND s.high
""")
def samples_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the segments between boundaries, both ends included."""
    knots = _table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id", "floor(event_id / 100.0) * 100 + 7 AS low").distinct()
    segments = knots.withColumn("high", F.lead("low").over(Window.partitionBy("user_id").orderBy("low"))).where("high IS NOT NULL")
    samples = _table(spark, sf_dir, "events").select("user_id", "event_id")
    return curation.within_segments(samples, segments, "user_id", "event_id", "low", "high", 256.0).select("event_id", "low", "high")


@query("""
WITH f AS (SELECT p_partkey AS file, p_size % 5 AS station, ['HNE', 'HNN', 'HNZ', '3'][p_partkey % 4 + 1] AS channel FROM part),
t AS (SELECT s_suppkey AS trace, s_nationkey % 5 AS station, ['HNE', '1', '2', '3'][s_suppkey % 4 + 1] AS channel, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE ['HNN', 'HNZ', 'HNE'][s_suppkey % 3 + 1] END AS chan_id FROM supplier)
SELECT file, trace, t.channel AS trace_channel FROM f JOIN t ON f.station = t.station AND (f.channel = t.channel OR (regexp_full_match(t.channel, '[0-9]+') AND t.chan_id = f.channel))
""")
def matched_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "part").selectExpr("p_partkey AS file", "p_size % 5 AS station", "array('HNE', 'HNN', 'HNZ', '3')[int(p_partkey % 4)] AS channel")
    traces = _table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS trace", "s_nationkey % 5 AS station", "array('HNE', '1', '2', '3')[int(s_suppkey % 4)] AS channel",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE array('HNN', 'HNZ', 'HNE')[int(s_suppkey % 3)] END AS chan_id",
    )
    return curation.match_channels(files, traces, ["station"]).select("file", "trace", "trace_channel")


_CHANNELS = "['HNE', 'N-S', ' HNZ', 'INTC', '080', 'UP', '350', 'other', 'EW']"
_BY_CHANNEL = """CASE WHEN trim(ch) IN ('N-S', '350') THEN 1 WHEN trim(ch) IN ('HNE', '080', 'EW') THEN 2 WHEN trim(ch) IN ('HNZ', 'UP') THEN 3 END"""


@query(f"""
WITH c AS (SELECT p_size AS station, p_partkey, {_CHANNELS}[p_partkey % 9 + 1] AS ch, p_retailprice AS v FROM part), k AS (SELECT *, {_BY_CHANNEL} AS k FROM c)
SELECT station, {", ".join(f"arg_max(trim(ch), p_partkey) FILTER (WHERE k = {k}) AS channel_{k}, arg_max(v, p_partkey) FILTER (WHERE k = {k}) AS v_{k}" for k in (1, 2, 3))} FROM k WHERE k IS NOT NULL GROUP BY 1
""")
def record_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components from channel names; of several channels of one component the last."""
    rows = _table(spark, sf_dir, "part").selectExpr("p_size AS station", "p_partkey", f"array{_CHANNELS.replace('[', '(').replace(']', ')')}[int(p_partkey % 9)] AS channel", "p_retailprice AS v")
    return records.components(rows, ["station"], "p_partkey", ["v"])


@query("""
SELECT o_orderkey, coalesce(c_name, 'Unknown') AS station_name, CAST(nullif(c_nationkey, 0) AS DOUBLE) AS vs30, CAST(nullif(floor(c_acctbal / 1000), 0) AS DOUBLE) AS azimuth, 'Undetermined' AS hvsr,
       CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN -(c_nationkey + 0.5)::DOUBLE ELSE -(o_orderkey % 90)::DOUBLE END AS lat,
       CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN CASE WHEN c_custkey IS NOT NULL THEN -70.5::DOUBLE END ELSE -(o_orderkey % 80)::DOUBLE END AS lon
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from either of two fields, else from the station table; defaults where a station is unknown."""
    place = "named_struct('lat', {lat}, 'lon', -double(o_orderkey % 80))"
    rows = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey AS code", f"CASE WHEN o_orderkey % 2 = 0 THEN {place.format(lat='CASE WHEN o_orderkey % 4 <> 0 THEN -double(o_orderkey % 90) END')} END AS location",
        f"CASE WHEN o_orderkey % 2 = 1 THEN {place.format(lat='-double(o_orderkey % 90)')} END AS loc",
    )
    rows = rows.select("o_orderkey", "code", *[F.when(F.col("o_orderkey") % 3 != 0, records.field(["location", "loc"], c)).alias(c) for c in ("lat", "lon")])
    stations = _table(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr(
        "c_custkey AS code", "double(c_nationkey) AS vs30", "double(floor(c_acctbal / 1000)) AS azimuth", "c_name AS name", "-(c_nationkey + 0.5D) AS lat", "-70.5D AS lon"
    )
    return records.with_station_defaults(rows, stations, "code").drop("code")


@query("SELECT user_id, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(*) - 1, 0), 6) AS step FROM events GROUP BY 1")
def mean_time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("ts")).alias("t"))
    return times.select("user_id", F.size("t").cast("long").alias("n"), F.round(records.mean_step(F.col("t")), 6).alias("step"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)
SELECT o_custkey, o_orderkey, 'st' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS station FROM o
""")
def station_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", records.ordinals(None, "o_custkey", ["o_orderdate", "o_orderkey"]).alias("station"))


@query("""
WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, min(i) FILTER (WHERE v > 0.2) AS first, max(i) FILTER (WHERE v > 0.2) AS last, round(sum(v) FILTER (WHERE i BETWEEN 1 AND n - 2), 6) AS inside
FROM s JOIN (SELECT vec_id, len(embedding) AS n FROM embeddings) USING (vec_id) GROUP BY 1
""")
def first_and_last_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last place over a level, and the sum of the interior of each record."""
    high = lambda v: v > 0.2
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", _record().alias("a"))
    inside = F.aggregate(records.interior(F.col("a")), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", records.first_where(F.col("a"), high).cast("long").alias("first"), records.last_where(F.col("a"), high).cast("long").alias("last"), F.round(inside, 6).alias("inside"))


@query("""
WITH e AS (SELECT vec_id, vec_id % 7 AS a, vec_id % 5 AS b, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 3 END AS c, len(embedding) AS n,
                  list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total FROM embeddings),
f AS (SELECT *, least(a, b, c) AS first FROM e),
g AS (SELECT *, (a - first) * 25 // 10 AS za, (b - first) * 25 // 10 AS zb, (c - first) * 25 // 10 AS zc FROM f)
SELECT vec_id, za AS zeros_1, zb AS zeros_2, zc AS zeros_3, greatest(za, zb, coalesce(zc, 0)) + n AS samples, c IS NULL AS lacks_3, round(total, 6) AS total_1 FROM g
""")
def shifted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components that start at different times, with zeros before and after; the third is missing in some records."""
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.transform(_record(), lambda v: v).alias(f"a{k}") for k in (1, 2)], F.when(F.col("vec_id") % 4 != 0, _record()).alias("a3"),
        *[(F.col("vec_id") % m / 4).alias(f"t{k}") for k, m in ((1, 7), (2, 5), (3, 3))],
    )
    made = rows.select("vec_id", "a1", "a3", "t1", "t2", "t3", *[c.alias(f"b{k}") for k, c in enumerate(records.aligned(["a1", "a2", "a3"], ["t1", "t2", "t3"], F.lit(0.1)).values(), 1)])
    lead = lambda k: (records.first_where(F.col(f"b{k}"), lambda v: v != 0)).cast("long").alias(f"zeros_{k}")
    return made.select("vec_id", *[lead(k) for k in (1, 2, 3)], F.size("b1").cast("long").alias("samples"), F.col("b3").isNull().alias("lacks_3"), F.round(F.aggregate("b1", F.lit(0.0), lambda s, v: s + v), 6).alias("total_1"))


@query("""
WITH p AS (SELECT c_nationkey AS event, 6378137.0 * radians(-(c_custkey % 70) - 1.0) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(-(c_custkey % 50) - 2.0) / 2)) AS y FROM customer),
b AS (SELECT event, count(*) AS points, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1), h AS (SELECT *, greatest(x1 - x0, y1 - y0) / 2 + 30000 AS d FROM b)
SELECT event, points, round((x0 + x1) / 2 - d, 2) AS xmin, round((x0 + x1) / 2 + d, 2) AS xmax, round((y0 + y1) / 2 - d, 2) AS ymin, round((y0 + y1) / 2 + d, 2) AS ymax FROM h
""")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload of a map: the points of an event in the plane and the square around them with 30 km to spare."""
    x, y = geo.mercator(F.expr("-(c_custkey % 70) - 1.0D"), F.expr("-(c_custkey % 50) - 2.0D"))
    points = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("event"), x.alias("x"), y.alias("y"))
    bounds = records.square_bounds(points, "event", "x", "y").join(points.groupBy("event").agg(F.count("*").alias("points")), "event")
    return _rounded(bounds, "xmin", "xmax", "ymin", "ymax", digits=2)


@query(f"""
WITH s AS (SELECT event_id, user_id, ts, event_type, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, starts, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s
""")
def type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the key of a sorted stream changes."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return curation.group_changes(rows, "event_type", ORDER, ["user_id"]).select("event_id", "starts", "run")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of the latest date, the first on ties: one aggregate, no sort of the table."""
    best = F.max_by(F.struct("o_custkey", "o_orderkey", "o_orderdate"), F.struct("o_orderdate", -F.col("o_orderkey")))
    return _table(spark, sf_dir, "orders").agg(best.alias("b")).where("b IS NOT NULL").select("b.*")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 events by date: a list for people, whose limit is the feature."""
    return curation.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 25)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_of_each_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_copies(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query("""
WITH k AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey >= 1000)
SELECT l_suppkey AS chain, l_linenumber AS partitions, count(*) AS n FROM k GROUP BY 1, 2
""")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a chain had each number of partitions after burn-in."""
    kept = _table(spark, sf_dir, "lineitem").where("l_orderkey >= 1000")
    return kept.groupBy(F.col("l_suppkey").alias("chain"), F.col("l_linenumber").alias("partitions")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT vec_id, unnest(embedding[2:len(embedding) - 1])::DOUBLE AS x FROM embeddings), h AS (SELECT least(floor((x + 1) / 0.1), 19)::BIGINT AS bin FROM b WHERE x BETWEEN -1 AND 1)
SELECT bin, count(*) AS n FROM h GROUP BY 1
""")
def boundary_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interior boundaries of all steps in bins of fixed width, the last one closed."""
    x = _table(spark, sf_dir, "embeddings").select(F.explode(records.interior(_record())).alias("x")).where("x BETWEEN -1 AND 1")
    return x.groupBy(F.least(F.floor((F.col("x") + 1) / 0.1), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT user_id, sum(length(props) * 100000.0::DOUBLE * (event_id % 50)) AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN b / 1048576 < 1024 THEN printf('%.2f', b / 1048576) || ' MB' ELSE printf('%.2f', b / 1073741824) || ' GB' END AS size FROM s
""")
def selection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.expr("length(props) * 100000.0D * (event_id % 50)")).alias("b"))
    return total.select("user_id", curation.size_text(F.col("b")).alias("size"))


_V = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""
WITH n AS (SELECT *, row_number() {_V} AS i FROM events), d AS (SELECT *, value - coalesce(avg(value) FILTER (WHERE i <= 10) OVER (PARTITION BY user_id), 0) AS a FROM n),
v AS (SELECT *, sum(s) {_V} AS v FROM (SELECT *, coalesce((a + lag(a) {_V}) / 2 * {DT}, 0) AS s FROM d)),
w AS (SELECT *, v - coalesce(avg(v) FILTER (WHERE i <= 10) OVER (PARTITION BY user_id), 0) AS u FROM v),
x AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM (SELECT event_id, user_id, ts, u, coalesce((u + lag(u) {_V}) / 2 * {DT}, 0) AS s FROM w))
SELECT event_id, round(u + 3e-8, 6) + 0 AS velocity, round(x + 3e-11, 6) + 0 AS displacement FROM x
""")
def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration without the mean before the arrival, integrated to velocity, that without its mean, to displacement."""
    keys = ["user_id"]
    flat = signals.remove_first_mean(_series(spark, sf_dir), "value", 10, keys, ORDER)
    moved = signals.remove_first_mean(signals.integrate(flat, "value", "velocity", DT, keys, ORDER), "velocity", 10, keys, ORDER)
    found = signals.integrate(moved, "velocity", "displacement", DT, keys, ORDER)
    # Values have 7 and 10 decimals; a little more keeps exact halves off the edge of the rounding.
    return found.select("event_id", F.round(F.col("velocity") + 3e-8, 6).alias("velocity"), F.round(F.col("displacement") + 3e-11, 6).alias("displacement"))


@query("""
WITH g AS (SELECT unnest(list_sort(list_distinct(list_concat(list_transform(range(0, 10), lambda i: round(pow(10, -3 + i * ((log10(2.0) + 3) / 9)), 9)), list_transform(range(0, 10), lambda i: round(0.0 + i * (2.0 / 9), 9)))))) AS period),
v AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings)
SELECT vec_id, period, round(peak * period / (2 * pi()), 9) AS velocity FROM v, g
""")
def velocity_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of an interactive spectrum and the pseudo-velocity of a constant pseudo-acceleration at them."""
    grid = F.array_sort(F.array_distinct(F.transform(records.period_grid(0.0, 2.0, 20), lambda t: F.round(t, 9))))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", grid.alias("t"), F.array_max(F.transform(_record(), F.abs)).alias("peak"))
    sv = records.velocity_spectrum(F.transform("t", lambda _: F.col("peak")), F.col("t"))
    both = rows.select("vec_id", F.explode(F.arrays_zip(F.col("t"), sv.alias("v"))).alias("p"))
    return both.select("vec_id", F.col("p.t").alias("period"), F.round("p.v", 9).alias("velocity"))


_ROTATED = """
WITH RECURSIVE p(t) AS (VALUES (0.1::DOUBLE), (0.5)), q AS (SELECT t, 2 * pi() / t AS w FROM p),
c AS (SELECT t, w, 1 + 0.05 * w * 0.01 + w * w * 0.0001 / 4 AS a1, 0.05 * w * 0.01 + w * w * 0.0001 / 4 AS a2, 2 * 0.05 * w + w * w * 0.01 AS a3 FROM q),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS y FROM embeddings),
s AS (
    SELECT vec_id, t, 1 AS j, 0::DOUBLE AS u, 0::DOUBLE AS v, -x[1] AS a, 0::DOUBLE AS u2, 0::DOUBLE AS v2, -y[1] AS b FROM e, c
    UNION ALL
    SELECT vec_id, t, j + 1, u + v * 0.01 + 0.0001 / 4 * (a + n), v + 0.01 / 2 * (a + n), n, u2 + v2 * 0.01 + 0.0001 / 4 * (b + m), v2 + 0.01 / 2 * (b + m), m
    FROM (SELECT s.*, (-e.x[s.j + 1] - s.a * c.a2 - s.v * c.a3 - s.u * c.w * c.w) / c.a1 AS n, (-e.y[s.j + 1] - s.b * c.a2 - s.v2 * c.a3 - s.u2 * c.w * c.w) / c.a1 AS m
          FROM s JOIN c USING (t) JOIN e USING (vec_id) WHERE s.j < len(e.x))
),
r AS (SELECT vec_id, t, k, pow(2 * pi() / t, 2) * max(abs(u * cos(pi() * k / 18) + u2 * sin(pi() * k / 18))) AS sa FROM s, range(0, 19) a(k) GROUP BY 1, 2, 3)
SELECT vec_id, t AS period, round(min(sa), 6) AS rotd0, round(median(sa), 6) AS rotd50, round(max(sa), 6) AS rotd100,
       round(sqrt(max(sa) FILTER (WHERE k = 0) * max(sa) FILTER (WHERE k = 9)), 6) AS geometric_mean FROM r GROUP BY 1, 2
"""


@query(_ROTATED)
def spectra_by_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated spectra at two periods, one damping and 19 angles, which SQL can follow; `rotated_spectra` has the whole table."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", _record().alias("x"), F.reverse(_record()).alias("y"))
    made = spectra.rotated_spectra(rows, ["vec_id"], "x", "y", DT, [0.1, 0.5], 0.05, 19)
    return _rounded(made, "rotd0", "rotd50", "rotd100", "geometric_mean")


@query("""
WITH o AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING sum(l_quantity) > 20)
SELECT s_suppkey, l_orderkey, l_linenumber, 'PENDING' AS status, []::DOUBLE[] AS corrected FROM o JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT l_suppkey AS k, l_orderkey, l_linenumber FROM lineitem) ON k = s_suppkey
""")
def records_to_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of a period column with all their records, whose corrected values are emptied and whose state is pending again."""
    wide = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", [*range(1, 8)]).agg(F.sum("l_quantity"))
    outliers = wide.where(F.col("1") > 20).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey")
    held = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber")
    return outliers.join(held, "s_suppkey", "left").select("s_suppkey", "l_orderkey", "l_linenumber", F.lit("PENDING").alias("status"), F.array().cast("array<double>").alias("corrected"))


@query("""
WITH p AS (SELECT o_orderkey, (o_orderkey % 10)::DOUBLE AS m, -(o_custkey % 60) - 0.5 AS lat, -(o_custkey % 25) - 60.25 AS lon, (o_custkey % 100)::DOUBLE AS h, CASE WHEN o_orderkey % 4 = 0 THEN -1.0 ELSE 5.0 END AS old FROM orders),
e AS (SELECT *, 6378.137 AS a, 6378.137 * (1 - 1 / 298.257223563) AS b, radians(lat) AS f, radians(lon) AS l FROM p WHERE old < 0),
d AS (SELECT *, sqrt(a * a * pow(cos(f), 2) + b * b * pow(sin(f), 2)) AS r, sqrt(a * a * pow(cos(radians(-33.4)), 2) + b * b * pow(sin(radians(-33.4)), 2)) AS q FROM e),
n AS (SELECT o_orderkey, sqrt(pow((a * a / r - h) * cos(f) * cos(l) - a * a / q * cos(radians(-33.4)) * cos(radians(-70.6)), 2)
    + pow((a * a / r - h) * cos(f) * sin(l) - a * a / q * cos(radians(-33.4)) * sin(radians(-70.6)), 2) + pow((b * b / r - h) * sin(f) - b * b / q * sin(radians(-33.4)), 2)) AS rhypo FROM d)
SELECT p.o_orderkey, round(coalesce(n.rhypo, p.old), 5) AS rhypo, n.rhypo IS NOT NULL AS refreshed FROM p LEFT JOIN n USING (o_orderkey)
""")
def refreshed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances worked out anew where they are missing, and only rows that changed by a tolerance written back."""
    rows = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "-(o_custkey % 60) - 0.5D AS lat", "-(o_custkey % 25) - 60.25D AS lon", "double(o_custkey % 100) AS depth", "CASE WHEN o_orderkey % 4 = 0 THEN -1.0D ELSE 5.0D END AS rhypo"
    )
    lacking = rows.where(curation.lacks_distances([F.col("rhypo")], [F.col(c) for c in ("lat", "lon", "depth")]))
    there = geo.ecef(F.lit(-33.4), F.lit(-70.6), F.lit(0.0))
    new = lacking.withColumn("new", geo.straight_distance(geo.ecef(F.col("lat"), F.col("lon"), F.col("depth")), there))
    changed = new.where(curation.differs(F.col("rhypo").cast("string"), F.col("new").cast("string"))).select("o_orderkey", F.col("new").alias("rhypo"), F.lit(True).alias("refreshed"))
    return _rounded(curation.refresh(rows.withColumn("refreshed", F.lit(False)), changed, ["o_orderkey"], ["rhypo", "refreshed"]).select("o_orderkey", "rhypo", "refreshed"), "rhypo", digits=5)


@query()
def spectral_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven kinds of spectra of records some of which lack components, at all periods and dampings of the table."""
    scaled = F.transform(_record(), lambda v: v / signals.GRAVITY)
    rows = _spread(spark, sf_dir).select(
        "vec_id", F.when(F.col("vec_id") % 5 != 0, scaled).alias("a1"), F.when(F.col("vec_id") % 7 != 0, F.reverse(scaled)).alias("a2"), scaled.alias("a3")
    )
    return spectra.spectral_batch(rows, ["vec_id"], ["a1", "a2", "a3"], DT, PERIODS, DAMPINGS, 181)
