"""Cutting the lineage of tables that are made in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.

    Where none is set, as in tests, a local session takes a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the driver ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _files(spark, folder)
    files.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, which goes with `dropped` or when the driver ends."""
    spark = df.sparkSession
    folder = working_folder(spark, "table")
    df.write.parquet(folder)
    made = spark.read.schema(df.schema).parquet(folder)
    made.table_folder = folder
    return made


def dropped(*tables: DataFrame) -> None:
    """Remove tables that `checkpointed` returned and nothing reads any more."""
    for made in tables:
        path, files = _files(made.sparkSession, made.table_folder)
        files.delete(path, True)
