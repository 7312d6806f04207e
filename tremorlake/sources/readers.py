"""Readers of catalogues, nested state and accelerograms, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an event catalogue as its files name them (fixed values).
CATALOGUE = "`Fecha (UTC)` timestamp, Latitud double, Longitud double, `Profundidad [km]` double, `Magnitud [*]` double, Estaciones string, Identificador string"
STATIONS = "`Station code` string, Latitude double, Longitude double, Vs30 double, Source int, Azimuth double, `Station name` string"
STATE = "map<string,map<string,struct<pos:int,status:string,method:string,corrected:boolean,updated:string>>>"
FAULT = "features array<struct<properties:struct<slip:double>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file by its header; identifiers stay text and a byte-order mark is dropped."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Rows (event, station, pos, status, method, corrected, updated) of a two-level JSON map."""
    text = spark.read.text(path, wholetext=True)
    events = text.select(F.explode(F.from_json("value", STATE)).alias("event", "stations"))
    return events.select("event", F.explode("stations").alias("station", "s")).select("event", "station", "s.*").withColumn("status", state_name(F.col("status")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_nested(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, value) of a JSON map of the given type of values; a file that is missing is an empty map."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {schema}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{schema}>")).alias("key", "value"))


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """`read_state`, where a missing file is a state without picks."""
    if exists(spark, path):
        return read_state(spark, path)
    return spark.createDataFrame([], "event string, station string, pos int, status string, method string, corrected boolean, updated string")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(event, station, registered) of the stations of each event; registered is null where it is not yet known."""
    rows = read_nested(spark, path, "map<string,boolean>")
    return rows.select(F.col("key").alias("event"), F.explode("value").alias("station", "registered"))


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(event, strike, dip, rake) of the fault planes; a list that is too short has nulls."""
    rows = read_nested(spark, path, "array<double>")
    return rows.select(F.col("key").alias("event"), *[F.get("value", F.lit(k)).alias(n) for k, n in enumerate(("strike", "dip", "rake"))])


def read_station_notes(spark: SparkSession, path: str) -> DataFrame:
    """(station, name, value) of the notes on stations, all values as text; numbers and lists stay as JSON has them."""
    rows = read_nested(spark, path, "map<string,string>")
    return rows.select(F.col("key").alias("station"), F.explode("value").alias("name", "value"))


def state_name(status):
    """PENDING, VALID, DISCARDED or POSTPONED from null, true, false and text."""
    return F.when(status.isNull(), "PENDING").when(status == "true", "VALID").when(status == "false", "DISCARDED").otherwise("POSTPONED")


def read_fault_models(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, patch, slip, vertex, lon, lat, depth) for each vertex of each patch of a finite-fault file."""
    files = spark.read.option("multiLine", True).schema(FAULT).json(path).select(F.input_file_name().alias("file"), F.posexplode("features").alias("patch", "f"))
    rings = files.select("file", "patch", F.col("f.properties.slip").alias("slip"), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("vertex", "p"))
    return rings.select("file", "patch", "slip", "vertex", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"), F.col("p")[2].alias("depth"))


def read_accelerograms(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text record: channel, start, rate, lat, lon and values from six `#` lines and the samples."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    word = lambda i, k: F.get(F.split(F.get(F.col("l"), F.lit(i)), r"\s+"), F.lit(k))
    values = F.filter(F.transform(F.slice("l", 7, 1 << 30), lambda v: F.trim(v).try_cast("double")), lambda v: v.isNotNull())
    return lines.select(
        F.regexp_extract("file", r"-([^-/]*)\.[^.]{3}$", 1).alias("channel"),
        F.element_at(F.split(F.get(F.col("l"), F.lit(0)), r"\s+"), -1).alias("start"),
        word(1, 4).try_cast("double").alias("rate"), word(4, 2).try_cast("double").alias("lat"), word(4, 4).try_cast("double").alias("lon"), values.alias("values"),
    )


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each file below a folder: file, name without its ending, mib and modified; contents are not read, files without bytes not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return files.select(F.col("path").alias("file"), name.alias("name"), (F.col("length") / (1 << 20)).alias("mib"), F.col("modificationTime").alias("modified"))


def read_fault_grid(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Patches of a text grid of a rupture: row, column, slip and ring (lon, lat, depth_m) from four neighbouring nodes.

    Lines that begin with `%` are remarks; the others hold lat, lon, two offsets, depth in km and slip, row by row with
    `columns` nodes each. The slip of a patch is the mean of its nodes. A file is one group: a grid has hundreds of nodes.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    lines = F.filter("l", lambda v: (F.trim(v) != "") & ~F.ltrim(v).startswith("%"))
    nodes = text.select("file", F.posexplode(lines).alias("n", "v")).withColumn("v", F.transform(F.split(F.trim("v"), r"\s+"), lambda w: w.try_cast("double")))
    node = F.struct(F.col("v")[1].alias("lon"), F.col("v")[0].alias("lat"), (F.col("v")[4] * 1000).alias("depth_m"), F.col("v")[5].alias("slip"))
    placed = nodes.select("file", F.floor(F.col("n") / columns).cast("int").alias("row"), (F.col("n") % columns).alias("column"), node.alias("p"))
    along, across = Window.partitionBy("file", "row").orderBy("column"), Window.partitionBy("file", "column").orderBy("row")
    pairs = placed.withColumn("q", F.lead("p").over(along))
    quads = pairs.withColumns({"p2": F.lead("p").over(across), "q2": F.lead("q").over(across)}).where("q IS NOT NULL AND q2 IS NOT NULL")
    corners = F.array("p", "q", "q2", "p2")
    slip = F.aggregate(corners, F.lit(0.0), lambda s, c: s + c["slip"]) / 4
    return quads.select("file", "row", "column", slip.alias("slip"), F.transform(corners, lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"), c["depth_m"].alias("depth_m"))).alias("ring"))


def read_slab(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (lon, lat, dep) of a Parquet grid of a slab's surface; holes (NaN or null) are left out."""
    nodes = spark.read.parquet(path).select(*[F.col(c).cast("double").alias(c) for c in ("lon", "lat", "dep")])
    return nodes.where("dep IS NOT NULL AND NOT isnan(dep)")


def read_records(spark: SparkSession, path: str, prefix: str = "st") -> DataFrame:
    """Records of events as Parquet, only those of keys that begin with `prefix`."""
    return spark.read.parquet(path).where(F.col("key").startswith(prefix))


def to_fetch(catalogue: DataFrame, progress: DataFrame, key: str, order: str, start: str | None = None) -> DataFrame:
    """Rows of a catalogue that an interrupted run has still to fetch: those from `start` on, by `order`, that its progress lacks."""
    rest = catalogue if start is None else catalogue.where(F.col(order) >= start)
    return rest.join(progress.select(key), key, "left_anti")
