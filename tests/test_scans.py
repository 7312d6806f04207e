"""Series in blocks: the same rows as plain windows and brute force, one record over many tasks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlake.operators import curation, peaks, scans, signals


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(2)
    rows = [("long", k, r.choice([None, 0.0, r.gauss(0, 1), float(r.randint(-3, 3))]), r.gauss(0, 1)) for k in range(700)]
    rows += [("short", k, r.gauss(0, 1), 0.5) for k in range(9)] + [(None, k, 1.0, 1.0) for k in range(40)] + [("one", 0, 2.0, 0.0), ("none", 0, None, None)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "key string, at long, v double, u double").repartition(5).cache()


def close(a, b):
    return a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def same(found, wanted, names):
    got = {(q.key, q.at): [q[n] for n in names] for q in found.collect()}
    want = {(q.key, q.at): [q[n] for n in names] for q in wanted.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert all(map(close, got[k], values)), (k, got[k], values)


def test_blocks_number_every_row(series):
    made = scans.in_blocks(series, ["key"], ["at"], 64)
    assert all(q["__i"] == q.at and q["__block"] == q.at // 64 for q in made.collect())
    tasks = made.where("key = 'long'").select("__block").distinct().count()
    assert tasks == 11 and made.groupBy("__key", "__block").count().agg(F.max("count")).first()[0] <= 64


@pytest.mark.parametrize("size", [32, 100_000])
def test_integrals_means_and_shares(series, size):
    blocks = scans.in_blocks(series.where("v IS NOT NULL"), ["key"], ["at"], size)
    flat = scans.remove_first_mean(blocks, "v", 10)
    made = scans.integrate(flat, {"velocity": F.col("v"), "energy": F.col("v") * F.col("v"), "cav": F.abs("v")}, 0.01)
    plain = signals.remove_first_mean(series.where("v IS NOT NULL"), "v", 10, ["key"], ["at"])
    plain = signals.intensity(signals.integrate(plain, "v", "velocity", 0.01, ["key"], ["at"]), "v", 0.01, ["key"], ["at"])
    made = made.withColumns({"arias": F.col("energy") * (math.pi / (2 * signals.GRAVITY)), "energy_share": F.col("energy") / F.nullif("energy_whole", F.lit(0.0))})
    same(made, plain, ["v", "velocity", "cav", "arias", "energy_share"])
    places = {q.key: q.places for q in scans.nearest_shares(made, "energy_share", ["key"]).collect()}
    held = {}
    for q in sorted(made.collect(), key=lambda q: q["__i"]):
        held.setdefault(q.key, []).append(q.energy_share)
    for key, shares in held.items():
        e = np.array([np.nan if s is None else s for s in shares])
        assert places[key] == [None if np.isnan(e).all() else int(np.nanargmin(np.abs(e - k / 10))) for k in range(1, 11)]


@pytest.mark.parametrize("size", [24, 100_000])
def test_frames_over_edges(series, size):
    blocks = scans.in_blocks(series, ["key"], ["at"], size)
    made = scans.moving_statistics(blocks, "v", 11, "m", "d", size)
    plain = series.withColumns({"m": signals.moving_average(F.col("v"), 11, ["key"], ["at"]), "d": signals.moving_deviation(F.col("v"), 11, ["key"], ["at"])})
    same(made, plain, ["m"])
    near = scans.sliding_likeness(blocks, "v", "u", 20, "s", size)
    rows = sorted(((q.key or "", q.at, q.v, q.u) for q in series.collect()), key=lambda q: q[:2])
    got = {(q.key or "", q.at): q.s for q in near.collect()}
    assert len(got) == len(rows)
    for k, (key, at, *_) in enumerate(rows):
        frame = [q for q in rows[k : k + 20] if q[0] == key]
        s = sum((v - u) ** 2 for *_, v, u in frame if v is not None and u is not None)
        assert close(got[key, at], math.sqrt(19 / s) if len(frame) == 20 and s > 0 else None)
    with pytest.raises(ValueError):
        scans.with_edges(blocks, size + 1, 0, size)


@pytest.mark.parametrize("size", [16, 100_000])
def test_last_known_and_interpolation(series, size):
    blocks = scans.in_blocks(series, ["key"], ["at"], size)
    w = Window.partitionBy("key").orderBy("at")
    same(scans.last_known(blocks, F.col("v"), "p"), series.withColumn("p", F.last("v", ignorenulls=True).over(w)), ["p"])
    same(scans.interpolate(blocks, "at", "v"), signals.interpolate(series, "at", "v", ["key"]), ["v"])


def test_as_of_of_a_hot_key(spark, series):
    knots = series.where("at % 37 = 5").select("key", "at", F.col("at").alias("boundary"))
    for size in (16, 100_000):
        got = {(q.key, q.at): q.boundary for q in curation.as_of(series.select("key", "at"), knots, "key", "at", ["boundary"], size).collect()}
        held = {q.key: [] for q in series.collect()}
        for q in knots.collect():
            held[q.key].append(q.boundary)
        assert got == {k: max((b for b in held[k[0]] if b <= k[1]), default=None) for k in got}


def greedy(values, distance):
    """Local maxima by height, later ones first on ties, none nearer than `distance` to one that stays."""
    found, i = [], 1
    while i < len(values) - 1:
        j = i
        while j + 1 < len(values) and values[j + 1] == values[i]:
            j += 1
        if j + 1 < len(values) and None not in (values[i - 1], values[i], values[j + 1]) and values[i - 1] < values[i] > values[j + 1]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (-values[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("distance, size", [(1, 16), (7, 64), (7, 100_000), (30, 16)])
def test_peaks_against_greedy(spark, distance, size):
    r = random.Random(distance + size)
    made = {
        "noise": [float(r.randint(0, 6)) for _ in range(900)], "up": [k + (k % 2) * 3.0 for k in range(500)], "plateau": [0.0] * 40 + [1.0] * 200 + [0.0] * 9,
        "holes": [r.choice([None, 1.0, 2.0, 3.0]) for _ in range(300)], "flat": [1.0] * 50, "one": [3.0], "smooth": [math.sin(k / 9) + math.sin(k / 31) for k in range(600)],
    }
    rows = [(k, i, v) for k, values in made.items() for i, v in enumerate(values)]
    r.shuffle(rows)
    found = peaks.find_peaks(spark.createDataFrame(rows, "name string, i long, v double"), ["name"], "i", "v", distance, size).collect()
    got = {k: sorted(q.i for q in found if q.name == k) for k in made}
    assert got == {k: greedy(v, distance) for k, v in made.items()}
    assert all(q.height == made[q.name][q.i] for q in found)


def test_segments_of_any_length(spark):
    r = random.Random(9)
    ends = [(r.uniform(-1e6, 1e6), 10 ** r.uniform(-2, 9)) for _ in range(60)]
    segments = [(k % 3, a, a + n) for k, (a, n) in enumerate(ends)] + [(0, 5.0, 5.0), (0, 7.0, 6.0), (1, None, 3.0), (1, float("nan"), 3.0), (1, 3.0, float("nan")), (2, float("-inf"), float("inf")), (None, 0.0, 1.0)]
    samples = [(r.randint(0, 2), r.choice([5.0, r.uniform(-1e6, 1e6), 10 ** r.uniform(0, 9)])) for _ in range(500)] + [(0, 5.0), (0, None), (None, 0.5)]
    a = spark.createDataFrame(samples, "key int, x double")
    b = spark.createDataFrame(segments, "key int, low double, high double")
    for width in (0.5, 256.0):
        got = sorted((q.key, q.x, q.low, q.high) for q in curation.within_segments(a, b, "key", "x", "low", "high", width).collect())
        want = sorted((k, x, lo, hi) for k, x in samples for s, lo, hi in segments if k == s and k is not None and None not in (x, lo, hi) and lo <= x <= hi)
        assert got == want
    whole = spark.range(2000).select((F.col("id") * 7919 % 100_003 - 50_000).alias("low"), (F.col("id") * 104_729 % (1 << 40)).alias("n"))
    cells = whole.select(F.size(curation.dyadic_cells(F.col("low"), F.col("low") + F.col("n"))).alias("c"), "n")
    assert cells.where("c > 2 * ceil(log2(n + 2)) OR c < 1").count() == 0
