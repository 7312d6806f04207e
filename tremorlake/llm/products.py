"""Exact search for the greatest inner products, by buckets of vectors of like length.

Vectors are sorted by length into buckets. A query's least score that counts, over its own length and the
greatest of a bucket, is the least cosine that a vector of the bucket must have: over 1 the bucket is left out;
otherwise vectors are ruled out by their length or, where the cosine is high, by the range that each of the query's
strongest coordinates allows. What is left is verified by whole inner products.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.codes import whole_vectors
from tremorlake.llm.runtime import cut, plain_names, shuffle_partitions

#: Scaled components beyond this count as this, so that inner products of up to 2**15 components are exact in 64 bits.
LARGEST = 1 << 24

#: Queries that are broadcast at once; each block of them is one pass over the vectors.
QUERIES_AT_ONCE = 4096

#: Vectors of a bucket.
BUCKET = 2048

#: Coordinates of a query that rule vectors out.
FOCUS = 4

#: Coordinates serve where they leave this share of a bucket at most, by the strongest one alone.
SHARE = 0.25

#: Room for the rounding of cosines; verified scores are whole numbers.
ROOM = 1e-9

#: The least score of a query of which nothing is known yet.
NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a column as rows, shorter ones followed by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = max(int(sizes.max(initial=0)), 1) if width is None else width
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two matrices of whole numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Bucket:
    """Vectors of like length, longest first, with their sorted coordinates."""

    def __init__(self, key: np.ndarray, known: np.ndarray, row: np.ndarray, vectors: np.ndarray) -> None:
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.key, self.known, self.row, self.vectors, self.length = key[order], known[order], row[order], vectors[order], length[order]
        unit = self.vectors / np.maximum(self.length, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def allowed(self, q: np.ndarray, f: int, cosine: float) -> tuple[int, int]:
        """The places in the order of coordinate f that hold all vectors of a `cosine` or more with the unit vector q."""
        across = math.sqrt(max(0.0, 1 - cosine**2) * max(0.0, 1 - q[f] ** 2))
        ends = q[f] * cosine - across - ROOM, q[f] * cosine + across + ROOM
        # Beyond its end the range is closed by 1: a vector along the coordinate itself has more than `cosine`.
        high = 1 + ROOM if q[f] >= cosine else ends[1]
        low = -1 - ROOM if -q[f] >= cosine else ends[0]
        return int(np.searchsorted(self.sorted[:, f], low, "left")), int(np.searchsorted(self.sorted[:, f], high, "right"))

    def candidates(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Vectors that the focus coordinates of q leave."""
        left = np.ones(len(self.row), dtype=bool)
        for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
            low, high = self.allowed(q, int(f), cosine)
            inside = np.zeros(len(left), dtype=bool)
            inside[self.order[low:high, f]] = True
            left &= inside
        return np.flatnonzero(left)


class Searcher:
    """The best candidates of a block of queries, bucket after bucket."""

    def __init__(self, queries: dict[str, np.ndarray], k: int) -> None:
        self.row, self.vectors, self.k = queries["row"], queries["vectors"], k
        self.length = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.unit = self.vectors / np.maximum(self.length, 1e-300)[:, None]
        self.least = queries["least"].copy()
        #: How often each way was taken: left out, by length, by coordinates.
        self.ways = [0, 0, 0]

    def _best(self, bucket: Bucket, q: int, which: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, int, int | None, int]]:
        """Rows of the best k of `which`; the least score of the query follows."""
        counts = (scores >= self.least[q]) & (bucket.row[which] != self.row[q])
        which, scores = which[counts], scores[counts]
        if len(which) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            which, scores = which[scores >= least], scores[scores >= least]
        order = np.lexsort((bucket.row[which], bucket.key[which], ~bucket.known[which], -scores))[: self.k]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])
        for i in order:
            yield int(self.row[q]), int(bucket.row[which[i]]), int(bucket.key[which[i]]) if bucket.known[which[i]] else None, int(scores[i])

    def search(self, bucket: Bucket) -> Iterator[tuple[int, int, int | None, int]]:
        width = bucket.vectors.shape[1]
        ask = self.unit[:, :width] if self.unit.shape[1] >= width else np.pad(self.unit, ((0, 0), (0, width - self.unit.shape[1])))
        reach = self.length * bucket.length[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, self.least / reach, np.where(self.least > 0, np.inf, -np.inf)) - ROOM
        live = cosine <= 1
        self.ways[0] += int((~live).sum())
        # The share that the strongest coordinate leaves tells from which local cosine on coordinates serve in this bucket.
        above = np.flatnonzero(live & (cosine > 0) & (self.unit.shape[1] <= width))
        above = above[np.argsort(-cosine[above], kind="stable")]
        strongest = np.abs(ask[above]).argmax(axis=1) if len(above) else above
        spans = [bucket.allowed(ask[q], int(f), min(1.0, cosine[q])) for q, f in zip(above, strongest)]
        shares = np.array([(high - low) / len(bucket.row) for low, high in spans])
        served = np.flatnonzero(np.cumsum(shares) / np.arange(1, len(shares) + 1) <= SHARE)
        by_coordinates = above[: served[-1] + 1] if len(served) else above[:0]
        for q in by_coordinates:
            which = bucket.candidates(ask[q], min(1.0, cosine[q]))
            self.ways[2] += 1
            if len(which):
                yield from self._best(bucket, q, which, _products(self.vectors[q : q + 1], bucket.vectors[which])[0])
        by_length = np.setdiff1d(np.flatnonzero(live), by_coordinates)
        for k in range(0, len(by_length), 256):
            block = by_length[k : k + 256]
            self.ways[1] += len(block)
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((self.least[block] > 0) & (self.length[block] > 0), self.least[block] / self.length[block] * (1 - ROOM) - ROOM, -1.0)
            ends = np.searchsorted(-bucket.length, -shortest, "right")
            scores = _products(self.vectors[block], bucket.vectors[: ends.max(initial=0)])
            for q, end, line in zip(block, ends, scores):
                yield from self._best(bucket, q, np.arange(end), line[:end])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    """Buckets of vectors that come longest first."""
    for batch in batches:
        for k in range(0, len(batch), BUCKET):
            part = batch.slice(k, BUCKET)
            key = part.column(1)
            yield Bucket(key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False), part.column(0).to_numpy(), _matrix(part.column(2)))


def _searching(queries, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries.value, k)
        for bucket in _buckets(batches):
            rows = list(searcher.search(bucket))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "row", "key", "score"])

    return search


def _best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


FOUND = "query bigint, row bigint, key bigint, score bigint"


def top_products(df: DataFrame, is_query: str, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """For each row that meets `is_query` the k rows of the greatest inner products of whole vectors floor(scale * x), itself left out.

    Returns query_id, rank (from 1), key of the row found under its own name, score; ties go to the smaller key (null keys
    last), then to the row read first. Fewer than k where there are fewer rows. Vectors null or with null, NaN or infinite
    components have no part; shorter vectors count as followed by zeros, empty ones score 0. Repeated rows are rows of
    their own, also as copies of a query. An empty table gives an empty result. Components beyond LARGEST / scale count as
    that. `is_query` names columns of `df`, which may have any names.

    Vectors lie in partitions by length, in buckets of BUCKET rows however many have one length. The queries are dealt in
    blocks of about `queries_at_once`, by hash, one broadcast at a time, each one pass over the vectors; a first pass over
    the longest BUCKET vectors gives every query a least score. A task returns at most k rows for each query and bucket.
    """
    spark = df.sparkSession
    source, names = plain_names(df.withColumn("__query", F.expr(is_query)))
    names_of = dict(zip([*df.columns, "__query"], names, strict=True))
    rows = source.select(F.monotonically_increasing_id().alias("row"), F.col(names_of[key]).cast("long").alias("key"), F.col(names_of[vector]).alias("vector"), F.coalesce(names_of["__query"], F.lit(False)).alias("asks"))
    rows = whole_vectors(rows, "vector", scale, LARGEST).withColumn("length", F.expr("aggregate(vector, 0D, (s, x) -> s + double(x) * x)"))
    # Rows of one length are dealt by their number as well: a length that very many share is no one task.
    sorted_ = cut(rows.repartitionByRange(shuffle_partitions(spark), F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row"))
    asked = sorted_.where("asks").count()
    blocks = max(1, -(-asked // queries_at_once))
    longest = sorted_.orderBy(F.desc("length"), "row").limit(BUCKET).select("row", "key", "vector")
    found = None
    for block in range(blocks):
        queries = sorted_.where("asks").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "key", "vector").toArrow()
        vectors = _matrix(queries.column("vector").combine_chunks()) if len(queries) else np.zeros((0, 1), dtype=np.int64)
        held = {"row": queries.column("row").to_numpy(), "vectors": vectors, "least": np.full(len(queries), NONE)}
        first = spark.sparkContext.broadcast(held)
        seeds = _best_of(longest.mapInArrow(_searching(first, k), FOUND), k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = {r["query"]: r["least"] for r in seeds.where(F.col("n") == k).collect()}
        held = held | {"least": np.array([least.get(int(r), NONE) for r in held["row"]], dtype=np.int64)}
        first.unpersist()
        part = sorted_.select("row", "key", "vector").mapInArrow(_searching(spark.sparkContext.broadcast(held), k), FOUND)
        part = cut(_best_of(part, k)) if blocks > 1 else _best_of(part, k)
        found = part if found is None else found.unionByName(part)
    ids = sorted_.where("asks").select(F.col("row").alias("query"), F.col("key").alias("query_id"))
    return found.join(ids, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
