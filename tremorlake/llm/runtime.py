"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where none is set, as in tests, a local session takes a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Remove a folder of the shared file system, now or when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path) if at_exit else files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a Parquet table in the shared folder, which goes with `drop_cut` or when the driver ends.

    It takes a third of the disk of an RDD checkpoint of the same rows.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    remove_folder(spark, folder, at_exit=True)
    made = spark.read.schema(df.schema).parquet(folder)
    made.cut_folder = folder
    return made


def drop_cut(*tables: DataFrame) -> None:
    """Remove tables that `cut` returned and nothing reads any more."""
    for made in tables:
        remove_folder(made.sparkSession, made.cut_folder)


def plain_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows under the names c0, c1, ..., which clash with no working column."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join with `right`, which has one row for each key and in `rows` how many of the `total` rows of `left` have it.

    At most 4096 keys can each have over a 4096th of all rows: these are broadcast, so that no task meets all rows of one.
    Both sides are read twice and should be tables.
    """
    heavy = right.where(F.col(rows) > total // 4096)
    spread = left.join(F.broadcast(heavy), keys)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return spread.unionByName(rest.join(right.where(F.col(rows) <= total // 4096), keys))
