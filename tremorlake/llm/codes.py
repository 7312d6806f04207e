"""Product codes of vectors: weighted Lloyd over the distinct parts of each position.

Vectors become integers and are cut into equal parts. Equal parts of one position are one row with a
weight; the rounds of Lloyd's method run over these rows alone, and codes and errors are then joined
back to the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.runtime import cut, drop_cut, plain_names, spread_join

#: Scaled components beyond this count as this, so that squared distances and sums of them are exact in 64 bits.
LARGEST = 1 << 24


@dataclass(frozen=True)
class Codes:
    """Factor of the components before they are floored, parts of a vector, entries of a codebook, rounds of Lloyd's method."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def whole_vectors(df: DataFrame, vector: str, scale: int, largest: int) -> DataFrame:
    """`vector` as whole numbers floor(scale * x), at most `largest` in size; rows whose vector is null or holds null, NaN or infinite components go."""
    held = df.where(f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> coalesce(abs(x) < double('infinity'), false))")
    whole = f"transform(`{vector}`, x -> cast(greatest(least(floor({scale}D * double(x)), {largest}L), -{largest}L) AS int))"
    return held.withColumn(vector, F.expr(whole))


def _arrays(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def nearest_entries(parts: np.ndarray, codebook: np.ndarray, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """For each part the number of its nearest entry, the lower on ties, and the squared distance."""
    code, error = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    for k in range(0, len(parts), at_once):
        far = ((parts[k : k + at_once, None, :] - codebook[None]) ** 2).sum(axis=2)
        code[k : k + at_once] = far.argmin(axis=1)
        error[k : k + at_once] = far.min(axis=1)
    return code, error


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, their parts) of a batch of pos, part and more."""
    pos = batch.column(0).to_numpy()
    parts = _arrays(batch.column(1), width)
    for p in np.unique(pos):
        rows = np.flatnonzero(pos == p)
        yield int(p), rows, parts[rows]


def _summed(codebooks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weights and weighted sums of the parts nearest to each entry, one row for each entry and batch."""
    width = codebooks.shape[2]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, made = batch.column(2).to_numpy(), []
            for pos, rows, parts in _by_position(batch, width):
                code, _ = nearest_entries(parts, codebooks[pos])
                for entry in np.unique(code):
                    mine = code == entry
                    w = weight[rows[mine]]
                    made.append((pos, int(entry), int(w.sum()), (parts[mine] * w[:, None]).sum(axis=0).tolist()))
            columns = list(zip(*made)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pos", "entry", "n", "total"])

    return summed


def _coded(codebooks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = codebooks.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.empty(len(batch), dtype=np.int32), np.empty(len(batch), dtype=np.int64)
            for pos, rows, parts in _by_position(batch, width):
                code[rows], error[rows] = nearest_entries(parts, codebooks[pos])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "code", "error"])

    return coded


def train_codebooks(distinct: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (position x entry x component) after `rounds` of weighted Lloyd over distinct (pos, part, n) rows.

    Sums of each entry are made where the rows are and added up by Spark; the driver sees one row for each entry. An
    entry becomes the floor of its parts' mean; one that no part is nearest to stays.
    """
    books = start.copy()
    for _ in range(rounds):
        sums = distinct.mapInArrow(_summed(books), "pos int, entry int, n bigint, total array<bigint>")
        each = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(start.shape[2])]
        for row in sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *each).collect():
            books[row["pos"], row["entry"]] = [row[f"t{i}"] // row["n"] for i in range(start.shape[2])]
    return books


def compress_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", spec: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """The rows with codes (array of int, one for each part) and error (squared distance over all parts), and the codebooks.

    Rows whose vector is null or holds null, NaN or infinite components go. So do rows whose vector has another length
    than that of the row of the smallest key whose length the parts divide; without such a row the result is empty.
    Codebooks start as the parts of the rows of the smallest keys (nulls last; of equal keys the smaller vector first) and
    have fewer entries where there are fewer rows. Ties go to the lower entry. Repeated rows count each and stay. Columns
    named codes or error are replaced, others may have any names. Components beyond LARGEST / scale count as that.

    Parts that very many vectors share are broadcast when they are joined, so that no task holds all vectors of one.
    """
    spark = df.sparkSession
    source, names = plain_names(df)
    k, v = names[df.columns.index(key)], names[df.columns.index(vector)]
    held = whole_vectors(source.withColumn("__whole", F.col(v)), "__whole", spec.scale, LARGEST)
    first = held.where(f"size(__whole) > 0 AND size(__whole) % {spec.parts} = 0").select(k, "__whole")
    by_key = [F.asc_nulls_last(k), F.asc("__whole")]
    size = first.orderBy(*by_key).limit(1).collect()
    new = ("codes", "error")
    shown = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c not in new]
    if not size:
        return held.where("false").select(*shown, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((spec.parts, 0, 0), dtype=np.int64)
    dimension = len(size[0]["__whole"])
    width = dimension // spec.parts
    heads = held.where(f"size(__whole) = {dimension}").select(k, "__whole").orderBy(*by_key).limit(spec.entries).collect()
    start = np.array([r["__whole"] for r in heads], dtype=np.int64).reshape(len(heads), spec.parts, width).transpose(1, 0, 2)

    kept = cut(held.where(f"size(__whole) = {dimension}").withColumn("__row", F.monotonically_increasing_id()))
    total = kept.count() * spec.parts
    cuts = f"posexplode(transform(sequence(0, {spec.parts - 1}), i -> slice(__whole, i * {width} + 1, {width}))) AS (pos, part)"
    parts = kept.selectExpr("__row", cuts)
    distinct = cut(parts.groupBy("pos", "part").agg(F.count("*").alias("n")))
    books = train_codebooks(distinct, start, spec.rounds)
    coded = cut(distinct.mapInArrow(_coded(books), "pos int, part array<int>, n bigint, code int, error bigint"))
    drop_cut(distinct)
    joined = spread_join(parts, coded, ["pos", "part"], "n", total)
    found = joined.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"), F.sum("error").alias("__error"))
    made = kept.join(found, "__row").select(*shown, F.transform("c", lambda c: c["code"]).alias("codes"), F.col("__error").alias("error"))
    return made, books


def with_totals(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Add the sum of `value` over all rows of an equal `by`, nulls together; null where it does not fit in 64 bits.

    Values that very many rows share are broadcast with their sums.
    """
    held = cut(df.withColumns({"__none": F.col(by).isNull(), "__by": F.coalesce(F.col(by).cast("string"), F.lit(""))}))
    sums = held.groupBy("__none", "__by").agg(F.try_sum(value).alias(out), F.count("*").alias("__n"))
    return spread_join(held, cut(sums), ["__none", "__by"], "__n", held.count()).select(*df.columns, out)
