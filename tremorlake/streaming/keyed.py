"""Tables of keyed rows that a stream merges into, of which each batch rewrites only what its keys touch.

Keys are hashed to buckets. The rows of a bucket lie in one folder, and a manifest for each batch names the folder of
every bucket. A batch reads the buckets of its keys, writes them anew in folders of its own and then the manifest;
the others keep their files. What two manifests no longer name is removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Combine = Callable[[DataFrame], DataFrame]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class KeyedTable:
    """Where the table lies, its keys, and how many buckets they are hashed to, the same for all batches."""

    folder: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self, spark: SparkSession) -> list[int]:
        path, files = _path(spark, f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, spark: SparkSession, number: int | None) -> dict[int, str]:
        """The folder of each bucket after batch `number`; none before the first."""
        if number is None:
            return {}
        text = spark.read.text(f"{self.folder}/manifests/{number}.json", wholetext=True).first()[0]
        return {int(b): f for b, f in json.loads(text).items()}

    def _write_manifest(self, spark: SparkSession, number: int, held: dict[int, str]) -> None:
        path, files = _path(spark, f"{self.folder}/manifests/{number}.json")
        draft, _ = _path(spark, f"{self.folder}/manifests/{number}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        files.delete(path, False)
        files.rename(draft, path)

    def read(self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """All rows, or those of some buckets, after the last batch or the last one before batch `before`; None where there are none."""
        numbers = [n for n in self._manifests(spark) if before is None or n < before]
        held = self._manifest(spark, numbers[-1] if numbers else None)
        folders = [f"{self.folder}/{f}" for b, f in held.items() if buckets is None or b in buckets]
        return spark.read.parquet(*folders) if folders else None

    def merge(self, batch: DataFrame, number: int, combine: Combine) -> None:
        """Batch `number` into the table: `combine` gives one row for each key from the old rows and the new ones of its bucket.

        Run again after a failure, it starts from the same manifest and gives the same table. A batch without rows leaves
        all as it is. The driver sees the numbers of the buckets only.
        """
        spark = batch.sparkSession
        numbers = [n for n in self._manifests(spark) if n < number]
        held = self._manifest(spark, numbers[-1] if numbers else None)
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())
        if not touched:
            return
        old = self.read(spark, touched, number)
        rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        made = combine(rows).withColumn("__bucket", self.bucket()).repartition(len(touched), "__bucket")
        made.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/data/{number}")
        new = held | {b: f"data/{number}/__bucket={b}" for b in touched}
        self._write_manifest(spark, number, new)
        for gone in numbers[:-1]:
            for folder in set(self._manifest(spark, gone).values()) - set(held.values()) - set(new.values()):
                path, files = _path(spark, f"{self.folder}/{folder}")
                files.delete(path, True)
            path, files = _path(spark, f"{self.folder}/manifests/{gone}.json")
            files.delete(path, False)


def newest(keys: tuple[str, ...], version: str, united: tuple[str, ...] = ()) -> Combine:
    """The row of the greatest version of each key, null the least, of equal ones the greatest of the other columns.

    The columns `united` hold texts of items between `"; "`; they become the sorted union of all rows of the key.
    """

    def combine(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*keys, version, *united)]
        items = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "; "))
        lists = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(items(c))))), "; ").alias(c) for c in united]
        best = rows.groupBy(*keys).agg(F.max(F.struct(version, *others)).alias("__best"), *lists)
        return best.select(*[F.col(c) if c in (*keys, *united) else F.col(f"__best.{c}").alias(c) for c in rows.columns])

    return combine


def arriving(spark: SparkSession, source: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the rows of Parquet files in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)


def merge_catalogue(rows: DataFrame, table: KeyedTable, version: str, united: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    """A stream of catalogue rows merged into `table`; ends when all that is there is read.

    The greatest version of a key counts, however late lower ones come; its lists are united over all versions; keys that
    no longer come stay. Read it with `table.read`.
    """
    combine = newest(table.keys, version, united)
    return (
        rows.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, combine))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
