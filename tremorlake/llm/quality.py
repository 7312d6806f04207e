"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, linear hinge loss."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.textkit import mix, run_hash, text_slices, words

#: Feature buckets.
BUCKETS = 1 << 16

#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 4000

#: Lengths of runs of one word that are features.
REPEATS = (2, 3, 4, 6, 8)

_U = np.uint64


def _shape_table() -> np.ndarray:
    """Classes of bytes: upper, lower and other letters, digits, white space; the rest is itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[128:], table[48:58] = 65, 97, 97, 57
    table[[9, 11, 12, 13]] = 32
    return table


_SHAPE = _shape_table()


def _text_features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct buckets of its word 1- and 2-grams and its shape 3- and 5-grams.

    The shape of a text has one symbol for each run of letters or digits of one class. Runs of
    one and the same word make features of their own, by length.
    """
    starts, ends, first = words(data, offsets)
    word = run_hash(11).of_bytes(data, starts, ends)
    pair = mix(word[1:] + word[:-1] * _U(0x9E3779B97F4A7C15) + _U(1))
    same = word[1:] == word[:-1]
    pair[same] = mix(_U([2]))
    counted = np.concatenate([[0], np.cumsum(same)])
    shape = _SHAPE[data]
    edge = np.ones(len(shape), dtype=bool)
    edge[1:] = (shape[1:] != shape[:-1]) | ~np.isin(shape[1:], (65, 97, 57))
    edge[offsets[:-1][offsets[:-1] < len(shape)]] = True
    places = np.flatnonzero(edge)
    symbols = run_hash(12).symbols[shape[places]]
    grams = {}
    for n in (3, 5):
        rolled = np.zeros(max(len(symbols) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            rolled = rolled * _U(0xD6E8FEB86659FD93) + symbols[k : k + len(rolled)]
        grams[n] = mix(rolled + _U(n))
    at = np.searchsorted(places, offsets)
    for i in range(len(offsets) - 1):
        a, b, c, d = first[i], first[i + 1], at[i], at[i + 1]
        parts = [word[a:b], pair[a : max(b - 1, a)], *(g[c : max(d - n + 1, c)] for n, g in grams.items())]
        if b > a and counted[b - 1] > counted[a]:
            runs = [n for n in REPEATS if b - a >= n and (counted[a + n - 1 : b] - counted[a : b - n + 1] == n - 1).any()]
            parts.append(mix(np.array(runs, dtype=np.uint64)))
        flags = np.zeros(buckets, dtype=bool)
        flags[(np.concatenate(parts) >> _U(20)) & _U(buckets - 1)] = True
        yield np.flatnonzero(flags)


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_slices(column):
        yield from _text_features(data, offsets, buckets)


@dataclass(frozen=True)
class QualityModel:
    """The margin is the sum of the found weights over the root of their number, plus the bias.

    The score is the logistic function of slope * margin + shift.
    """

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, buckets: int, alpha: float = 1.0) -> np.ndarray:
    """log of the share of a feature among positive documents over that among negative ones."""
    totals = {}
    for y in (True, False):
        counts = np.full(buckets, alpha)
        for row in (r for r, p in zip(rows, positive, strict=True) if p == y):
            counts[row] += 1
        totals[y] = counts / counts.sum()
    return np.log(totals[True] / totals[False])


def dual_coordinate_descent(
    rows: list[np.ndarray], scale: np.ndarray, positive: np.ndarray, cost: np.ndarray, passes: int = 12, seed: int = 5
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear L1 hinge loss over indicators times `scale`, one dual variable at a time.

    `cost` bounds each document's dual variable. Rows are divided by the root of their number of
    features, as when they are scored; the bias is one more feature of value 1.
    """
    sign = np.where(positive, 1.0, -1.0)
    norms = np.sqrt([max(len(r), 1) for r in rows])
    weights, bias = np.zeros(len(scale)), 0.0
    dual = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(passes):
        largest = 0.0
        for i in random.permutation(len(rows)):
            values = scale[rows[i]] / norms[i]
            gradient = sign[i] * (weights[rows[i]] @ values + bias) - 1
            moved = min(max(dual[i] - gradient / (values @ values + 1), 0.0), cost[i])
            step = (moved - dual[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values
                bias += step
                largest = max(largest, abs(step))
                dual[i] = moved
        if largest < 1e-3:
            break
    return weights, bias


def _calibrate(margins: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the class by the margin, by Newton steps."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        error, curve = weight * (p - positive), weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(error * margins).sum() + 1e-3 * slope, error.sum()])
        hessian = np.array([[(curve * margins**2).sum() + 1e-3, (curve * margins).sum()], [(curve * margins).sum(), curve.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        slope, shift = slope - float(np.clip(step[0], -5, 5)), shift - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-6:
            break
    return max(slope, 1e-3), shift


def fit(rows: list[np.ndarray], positive: np.ndarray, buckets: int = BUCKETS, prior: float | None = None) -> QualityModel:
    """Fit on distinct buckets and classes; `prior` is the share of positives among all labelled rows.

    Calibration is on margins of documents left out of the fit, in two folds. With one class
    only, or no rows, all scores are the prior (1 without rows).
    """
    prior = float(positive.mean()) if prior is None and len(rows) else 1.0 if prior is None else prior
    if not len(rows) or positive.all() or not positive.any():
        shift = float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6))))
        return QualityModel(np.zeros(buckets), 0.0, 1.0, shift)

    def part(keep: np.ndarray) -> tuple[np.ndarray, float]:
        own, classes = [rows[i] for i in np.flatnonzero(keep)], positive[keep]
        ratios = log_count_ratios(own, classes, buckets)
        share = max(classes.mean(), 1e-6)
        cost = np.where(classes, min(1.0, (1 - share) / share), min(1.0, share / max(1 - share, 1e-6)))
        weights, bias = dual_coordinate_descent(own, ratios, classes, cost)
        return weights * ratios, bias

    def margins(model: tuple[np.ndarray, float], which: np.ndarray) -> np.ndarray:
        return np.array([_margin(*model, rows[i]) for i in which])

    fold = np.arange(len(rows)) % 2 == 0
    left = np.zeros(len(rows))
    if all(0 < positive[f].sum() < f.sum() for f in (fold, ~fold)):
        for f in (fold, ~fold):
            left[~f] = margins(part(f), np.flatnonzero(~f))
    weights, bias = part(np.ones(len(rows), dtype=bool))
    if not left.any():
        left = margins((weights, bias), np.arange(len(rows)))
    weight = np.where(positive, prior / positive.mean(), (1 - prior) / (1 - positive.mean()))
    return QualityModel(weights, bias, *_calibrate(left, positive.astype(float), weight))


def _margin(weights: np.ndarray, bias: float, found: np.ndarray) -> float:
    return float(weights[found].sum()) / np.sqrt(max(len(found), 1)) + bias


def _buckets_of(docs: DataFrame, text: str, extra: list[str], buckets: int) -> DataFrame:
    schema = T.StructType([*docs.select(*extra).schema.fields, T.StructField("found", T.ArrayType(T.IntegerType()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32) for f in features(batch.column(batch.num_columns - 1), buckets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*extra, "found"])

    return docs.select(*extra, F.col(f"`{text}`").alias("__text")).mapInArrow(made, schema)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    keep: Column,
    text: str = "text",
    per_class: int = PER_CLASS,
    buckets: int = BUCKETS,
) -> QualityModel:
    """Fit on labelled rows of `labels` that meet `keep`, at most `per_class` of each class.

    The sample is that of the least hashes of doc_id, so it does not depend on the order of
    the rows. Its size is bounded, so its ids are broadcast to the scan of the documents.
    Null ids and labels are left out; rows that repeat a doc_id count once. Other columns of
    `docs`, whatever their names, play no part.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(keep & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = usable.agg(F.avg("y")).collect()[0][0]
    order = F.xxhash64("doc_id")
    picked = usable.where("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(
        usable.where("y = 0").orderBy(order, "doc_id").limit(per_class)
    )
    texts = docs.select("doc_id", F.coalesce(f"`{text}`", F.lit("")).alias("t"))
    # Rows that repeat a doc_id are one document of the sample, the one of the least text.
    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t"))
    # Arrow columns, not rows of Python numbers: the sample takes a few dozen MB on the driver.
    sample = _buckets_of(chosen, "t", ["doc_id", "y"], buckets).toArrow()
    found = [f.values.to_numpy() for f in sample.column("found")]
    # The ids are distinct, whatever their type.
    ids, y = sample.column("doc_id").to_pylist(), sample.column("y").to_numpy()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    model = fit([found[i] for i in order], y[order] == 1, buckets, share)
    del sample, found
    pa.default_memory_pool().release_unused()
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 if score >= threshold, else 0) to every row.

    Only the whole text counts. A null text is empty; an empty text has no features and
    scores by the bias alone. Columns of these names are replaced; repeated rows and equal texts
    score alike, ties of scores play no part; an empty table gives an empty result. A very long text
    is taken whole, in a slice of its own.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    source = docs.toDF(*names)
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            margins = np.array([_margin(m.weights, m.bias, f) for f in features(batch.column(at), len(m.weights))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.score(margins), pa.float64())], [*names, "score"])

    return source.mapInArrow(scored, schema).select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in ("score", "predicted")],
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text modulo 5; 0 is the held-out fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5
