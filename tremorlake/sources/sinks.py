"""Writers of records, tables and nested state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.relations import upsert
from tremorlake.sources.readers import exists


def write_records(df: DataFrame, path: str, by: str = "event") -> None:
    """Records as Parquet, a folder for each event; folders of other events stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def nested_state(df: DataFrame, event: str, station: str, value: Column) -> DataFrame:
    """One JSON text for each event: its stations, sorted, with their values."""
    made = df.groupBy(event).agg(F.array_sort(F.collect_list(F.struct(F.col(station).alias("key"), value.alias("value")))).alias("__s"))
    return made.select(event, F.to_json(F.map_from_entries("__s")).alias("stations"))


def merge_sorted_csv(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Rows of `old` and `new`, which win, sorted by their keys; `path` must not be what `old` reads."""
    upsert(old, new, keys).orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def write_progress(rows: DataFrame, folder: str, stamp: str) -> str:
    """What a run has done before it failed, in a folder of its own; returns its name."""
    name = f"{folder}/progress-{stamp}"
    rows.write.mode("errorifexists").option("header", True).csv(name)
    return name


def merge_sorted_lines(old: str, new: DataFrame, keys: list[str], path: str) -> None:
    """The lines of a sorted CSV file, byte for byte, with the rows of `new` in their places, as text files in order at `path`.

    A row of `new` takes the place of all old lines of its keys. Lines are sorted by the keys as texts; old lines of equal
    keys stay in their order, as do those without keys, which come first. The header stays the first line and gives the
    order of the columns of `new`; a column that it names and `new` lacks is empty. New lines end as the header does.
    Lines are payload from the read to the write: only the keys are parsed. The files, one after the other, are the new file.
    """
    spark = new.sparkSession
    lines = spark.read.option("lineSep", "\n").text(old)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    header = lines.first()[0]
    end = "\r" if header.endswith("\r") else ""
    names = [n.strip('"') for n in header.removesuffix("\r").removeprefix("\ufeff").split(",")]
    parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
    held = lines.select("value", place.alias("place")).withColumn("k", F.struct(*[parsed[k].alias(k) for k in keys]))
    first = F.lit(header)
    body = held.where(F.col("value") != first)
    columns = [F.col(f"`{n}`").cast("string").alias(n) if n in new.columns else F.lit(None).cast("string").alias(n) for n in names]
    made = new.select(F.struct(*[F.col(f"`{k}`").cast("string").alias(k) for k in keys]).alias("k"), F.concat(F.to_csv(F.struct(*columns)), F.lit(end)).alias("value"))
    kept = body.join(made.select("k").distinct(), "k", "left_anti").select("k", "place", "value", F.lit(1).alias("rank"))
    top = held.where(F.col("value") == first).orderBy("place").limit(1).select("k", "place", "value", F.lit(0).alias("rank"))
    both = kept.unionByName(top).unionByName(made.select("k", "value", F.lit(1).alias("rank")), allowMissingColumns=True)
    ordered = both.orderBy("rank", F.when(F.col("rank") > 0, F.col("k")), "place")
    ordered.select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def promote(spark: SparkSession, draft: str, main: str, by: str = "event") -> list[str]:
    """Move the folders of a draft (`by`=value) over those of the main table; returns the values. Other folders stay.

    Each folder is first put beside the one it replaces, which is then removed, and takes its name at last: a call that was
    broken off is finished by the next one. Only names are changed, no rows are read.
    """
    made = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not exists(spark, main):
        made(main).getFileSystem(conf).mkdirs(made(main))
    files = made(main).getFileSystem(conf)
    done = set()

    # Readers leave out names that begin with _ and hold no =.
    moved = lambda name: f"{main}/_moved-{name.replace('=', '@', 1)}"

    def finish(name: str) -> None:
        target = made(f"{main}/{name}")
        files.delete(target, True)
        files.rename(made(moved(name)), target)
        done.add(name.partition("=")[2])

    for left in [f.getPath().getName() for f in files.listStatus(made(main))]:
        if left.startswith("_moved-"):
            finish(left.removeprefix("_moved-").replace("@", "=", 1))
    if exists(spark, draft):
        for name in sorted(f.getPath().getName() for f in files.listStatus(made(draft)) if f.isDirectory()):
            if name.startswith(f"{by}="):
                files.rename(made(f"{draft}/{name}"), made(moved(name)))
                finish(name)
    return sorted(done)
