"""Catalogue files that arrive one by one, merged into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key; of equal ones the row that sorts last."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), *[F.desc_nulls_last(c) for c in rows.columns if c not in (*keys, version)])
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def merge_stream(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Keep in `target` the greatest version of each key of the files in `source`; ends when all are read.

    A version that comes late never takes the place of a greater one; keys that no longer come stay.
    Each batch is a table of its own, `target/<batch>`, made from the last one, which goes when the
    next but one is there; a batch that is run again after a failure is written again from the same
    table. Read the one of the largest number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/{number - 1}").unionByName(batch)
        latest(rows, keys, version).write.mode("overwrite").parquet(f"{target}/{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{number - 2}")
        if number > 1:
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
