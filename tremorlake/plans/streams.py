"""Queries that run streams over the tables until all is read, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.lineage import working_folder
from tremorlake.plans.catalog import _table, query
from tremorlake.streaming.keyed import KeyedTable, arriving, merge_catalogue
from tremorlake.streaming.review import keep_reviews, review_states

_VERDICTS = "CASE WHEN l_returnflag = 'A' THEN 'valid' WHEN l_returnflag = 'R' THEN 'discarded' WHEN l_partkey % 2 = 0 THEN 'corrected' ELSE 'postponed' END"
_DECISIONS = f"l_suppkey AS event, l_linenumber AS station, CAST(l_orderkey AS BIGINT) AS at, CAST(l_partkey % 1000 AS BIGINT) AS position, {_VERDICTS} AS verdict, l_linestatus = 'O' AS moved"
_REVIEWED = f"""
WITH d AS (SELECT {_DECISIONS.replace("AS at", 'AS "at"').replace("AS position", 'AS "position"')} FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY event, station ORDER BY "at" DESC, "position" DESC, verdict DESC, moved DESC) AS r FROM d WHERE verdict <> 'corrected'),
c AS (SELECT event, station, max("at") AS c FROM d WHERE verdict = 'corrected' GROUP BY 1, 2)
SELECT event, station, "at", "position", upper(verdict) AS status, CASE WHEN moved THEN 'Manual' ELSE 'Automatic' END AS method, coalesce(verdict = 'valid' AND c > "at", false) AS corrected
FROM k LEFT JOIN c USING (event, station) WHERE r = 1
"""


@query(_REVIEWED)
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each pick: lines of orders as decisions and corrections on the picks of suppliers, in one aggregate."""
    return review_states(_table(spark, sf_dir, "lineitem").selectExpr(*_DECISIONS.split(", ")), ["event", "station"])


@query(_REVIEWED)
def review_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the decisions, whose states are kept by pick."""
    folder = working_folder(spark, "review")
    schema = _table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/lineitem.parque[t]")
    table = KeyedTable(f"{folder}/table", ("event", "station"))
    keep_reviews(stream.selectExpr(*_DECISIONS.split(", ")), table, f"{folder}/checkpoint").awaitTermination()
    return table.read(spark).select("event", "station", "at", "position", "status", "method", "corrected")


@query("""
SELECT o_custkey AS event, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS record, max(o_orderdate) AS updated,
       array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS stations FROM orders GROUP BY 1
""")
def catalogue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each event and the stations of all, merged file by file into a table in buckets."""
    folder = working_folder(spark, "catalogue")
    schema = _table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/orders.parque[t]")
    rows = stream.select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("updated"), F.col("o_orderpriority").alias("stations"))
    table = KeyedTable(f"{folder}/table", ("event",))
    merge_catalogue(rows, table, "updated", ("stations",), f"{folder}/checkpoint").awaitTermination()
    return table.read(spark).select("event", "record", "updated", "stations")
