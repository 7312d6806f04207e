import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import columns, geo
from tremorlake.operators import records, relations, sampler, spectra
from tremorlake.sources import readers, sinks
from tremorlake.streaming.upserts import merge_stream


def test_geodesic_against_known_lengths(spark):
    got = geo.vincenty_inverse(np.array([0.0, 0.0, -33.0]), np.array([0.0, 0.0, -70.0]), np.array([0.0, 1.0, -33.0]), np.array([1.0, 0.0, -70.0]))
    assert got == pytest.approx([111.319491, 110.574389, 0.0], abs=1e-5)


def test_geodesic_there_and_back(spark):
    """The azimuth back from the end leads to the start over the same length."""
    r = np.random.default_rng(1)
    p, l, a, s = r.uniform(-80, 80, 200), r.uniform(-180, 180, 200), r.uniform(0, 360, 200), r.uniform(1, 5e6, 200)
    lat, lon, back = geo.vincenty_ends(p, l, a, s)
    home, home_l, again = geo.vincenty_ends(lat, lon, back, s)
    assert home == pytest.approx(p, abs=1e-9) and np.mod(home_l - l + 180, 360) - 180 == pytest.approx(np.zeros(200), abs=1e-8)
    assert np.mod(again - a + 180, 360) - 180 == pytest.approx(np.zeros(200), abs=1e-7) and back.min() >= 0 and back.max() < 360
    still = geo.vincenty_ends(np.array([10.0]), np.array([20.0]), np.array([30.0]), np.array([0.0]))
    assert [x[0] for x in still] == pytest.approx([10.0, 20.0, 210.0])


def test_spectrum_at_zero_and_rotation(spark):
    a = np.sin(np.arange(200) * 0.3)
    row = [(1, a.tolist(), (-a).tolist()), (2, [], []), (3, None, None)]
    df = spark.createDataFrame(row, "k int, x array<double>, y array<double>")
    sa = {r.k: r.s for r in df.select("k", spectra.response_spectrum(F.col("x"), 0.01, [0.0, 0.2], 0.05).alias("s")).collect()}
    assert sa[1][0] == pytest.approx(np.abs(a).max()) and sa[2] is None and sa[3] is None
    rows = spectra.rotated_spectra(df, ["k"], "x", "y", 0.01, [0.0, 0.2], 0.05, 181).collect()
    assert len(rows) == 2 and all(r.rotd0 <= r.rotd50 <= r.rotd100 for r in rows)
    assert rows[1].rotd100 == pytest.approx(sa[1][1] * np.sqrt(2), rel=1e-6)


def test_turned_peaks_are_those_of_all_samples():
    """Left out are only samples inside the hull: thin, round and flat orbits, points on a line, equal and missing ones."""
    random = np.random.default_rng(4)
    turns = np.pi * np.arange(181) / 180
    turn = np.stack([np.cos(turns), np.sin(turns)])
    a, b = random.normal(size=(2, 90, 40)) * np.exp(random.normal(size=(2, 90, 1)) * 3)
    a[:20], b[:20] = np.cos(np.arange(40) * 0.7), np.sin(np.arange(40) * 0.7)  # all on the hull
    b[20:30] = 3 * a[20:30]
    a[30:35] = b[30:35] = 0.0
    a[35:40], b[35:40] = a[35:40, :1], b[35:40, :1]
    b[40:45] = 0.0
    want = np.abs(a[:, :, None] * turn[0] + b[:, :, None] * turn[1]).max(axis=1)
    got = spectra.turned_peaks(a, b, turn)
    assert np.abs(got - want).max(axis=1) == pytest.approx(np.zeros(90), abs=1e-12 * max(np.abs(a).max(), np.abs(b).max()))
    assert got == pytest.approx(want, rel=1e-12, abs=1e-12)
    a[50, 3] = np.nan
    assert np.isnan(spectra.turned_peaks(a, b, turn)[50]).all()


def test_sampler_finds_a_corner(spark):
    x = np.linspace(0, 10, 120)
    y = np.where(x < 4, 0.0, 3 * (x - 4))
    df = spark.createDataFrame([("a", float(p), float(q), 0.3) for p, q in zip(x, y)], "k string, x double, y double, s double")
    history = sampler.connected_lines(df, "k", "x", "y", "s", total=6000)
    best = sampler.best_of_mode(history, "k", 1000).first()
    assert np.abs(np.interp(x, best.xs, best.ys) - y).max() < 2.0
    again = sampler.best_of_mode(sampler.connected_lines(df, "k", "x", "y", "s", total=6000), "k", 1000).first()
    assert again == best


def test_best_line_without_history(spark):
    """Chains side by side end where the history of each one does, for groups of any length, place and spread."""
    random = np.random.default_rng(5)
    rows = []
    for k, n in enumerate((3, 4, 9, 60, 200)):
        x = np.sort(random.uniform(0, 2e6, n)) + 1.7e9
        rows += [(f"g{k}", float(p), float(q), 2.0 if k < 4 else 1e-9) for p, q in zip(x, random.exponential(10, n) + (x > x[n // 2]) * 40)]
    rows += [(None, float(i // 4), float(i % 3), 0.5) for i in range(12)] + [("still", 7.0, float(i), 1.0) for i in range(6)]
    rows += [("g3", None, 1.0, 1.0), ("g3", 1.7e9, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, s double")
    whole = sampler.best_of_mode(sampler.connected_lines(df, "k", "x", "y", "s", total=700), "k", 100)
    plan = sampler.connected_lines(df.repartition(3), "k", "x", "y", "s", total=700, burn_in=100)
    assert plan.columns == whole.columns
    want, got = ({q.k: q for q in d.collect()} for d in (whole, plan))
    assert set(got) == {"g1", "g2", "g3", "g4", None, "still"}
    assert all(got[k] == want[k] for k in ("g1", "g2", "g3", "g4", "still"))
    for k in ("g2", "g3"):  # the misfit of sums is that of the samples
        p, q, s = np.array([r[1:] for r in rows if r[0] == k and r[1] and r[2] == r[2]]).T
        assert got[k].misfit == pytest.approx((((q - np.interp(p, got[k].xs, got[k].ys)) / (2 * s)) ** 2).sum(), rel=1e-7)
        assert len(got[k].xs) == got[k].partitions + 1 and got[k].xs[0] == p.min() and got[k].xs[-1] == p.max()


def test_event_id_of_missing_parts(spark):
    df = spark.createDataFrame([("2010-02-27", "8.8", None, None, "30.0")], "d string, m string, a string, o string, h string")
    made = df.select(columns.event_id(F.to_date("d"), F.col("m"), F.col("a"), F.col("o"), F.col("h")).alias("id"))
    assert made.first().id == "20100227_8.8M_latS_lonW_30.0KM"
    parts = made.select(*[v.alias(k) for k, v in columns.parsed_event_id(F.col("id")).items()]).first()
    assert (parts.magnitude, parts.latitude, parts.depth) == (8.8, None, 30.0)


def test_change_detection(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    seen = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, v string")
    assert {r.k for r in relations.new_or_changed(now, seen, ["k"], "v").collect()} == {2, 4}
    assert {r.v for r in relations.drop_all_copies(now.union(seen), ["k", "v"]).collect()} == {"b", "x", "d"}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿Fecha (UTC),Latitud,Longitud,Profundidad [km],Magnitud [*],Estaciones,Identificador\n2010-02-27 06:34:08,-36.1,,30,8.8,A; B,007\n", encoding="utf-8")
    row = readers.read_csv(spark, str(tmp_path / "c.csv"), readers.CATALOGUE).first()
    assert row.Identificador == "007" and row.Longitud is None
    (tmp_path / "p.json").write_text('{"e": {"s": {"pos": 3, "status": null}, "t": {"pos": 4, "status": "postponed", "corrected": false}}}')
    state = readers.read_state(spark, str(tmp_path / "p.json"))
    assert {(r.station, r.status) for r in state.collect()} == {("s", "PENDING"), ("t", "POSTPONED")}
    nested = sinks.nested_state(state, "event", "station", F.col("pos")).first()
    assert nested.stations == '{"s":3,"t":4}'
    (tmp_path / "x-HNE.txt").write_text("# start 2010-02-27T06:34:08\n# rate is equal 100 Hz\n#\n#\n# lat -33.4 lon -70.6\n#\n1.5\n-2\n")
    record = readers.read_accelerograms(spark, str(tmp_path / "x-HNE.txt")).first()
    assert record.channel == "HNE" and record["values"] == [1.5, -2.0] and record.rate == 100
    (tmp_path / "f.geojson").write_text('{"features": [{"properties": {"slip": 2.0}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2, 3], [4, 5, 6]]]}}]}')
    assert readers.read_fault_models(spark, str(tmp_path / "f.geojson")).count() == 2
    sinks.write_records(state, str(tmp_path / "records"))
    assert spark.read.parquet(str(tmp_path / "records")).count() == 2


def test_stream_merges_latest_versions(spark, tmp_path):
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 1)]]):
        spark.createDataFrame(rows, "k int, v string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merge_stream(spark, str(tmp_path / "in"), "k int, v string, n int", str(tmp_path / "out"), ["k"], "n", str(tmp_path / "cp")).awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name))
    assert {r.k for r in spark.read.parquet(str(last)).collect()} == {1, 2, 3}


def test_stream_keeps_the_greater_version(spark, tmp_path):
    """A late file with a lower version changes nothing, in the order of arrival or within a file."""
    seen = set()
    for k, rows in enumerate([[(1, "new", 10), (2, "b", 1)], [(1, "late", 5), (3, "x", 2), (3, "y", 2)], [(2, "c", 7)], [(2, "d", 6)]]):
        spark.createDataFrame(rows, "k int, v string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if f not in seen:
                os.utime(f, (1e9 + k, 1e9 + k))
                seen.add(f)
    merge_stream(spark, str(tmp_path / "in"), "k int, v string, n int", str(tmp_path / "out"), ["k"], "n", str(tmp_path / "cp")).awaitTermination()
    held = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name))
    assert {(r.k, r.v, r.n) for r in spark.read.parquet(str(held[-1])).collect()} == {(1, "new", 10), (2, "c", 7), (3, "y", 2)}
    assert len(held) == 2


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(3)
    grid = [(i, float(x), float(y), float(-i)) for i, (x, y) in enumerate(r.integers(0, 40, (200, 2)) / 4)] + [(200, None, 1.0, 0.0), (201, 3.0, 3.0, 0.0), (202, 3.0, 3.0, 1.0)]
    left = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-3, 14, (150, 2)))] + [(150, 3.0, 3.0), (151, None, 2.0), (152, 500.0, -700.0), (150, 3.0, 3.0)]
    a = spark.createDataFrame(left, "k int, x double, y double")
    b = spark.createDataFrame(grid, "i int, gx double, gy double, dep double")
    got = sorted((q.k, q.i) for q in relations.nearest_in_plane(a, b, "k", ("x", "y"), ("gx", "gy"), ["i"], "i").collect())
    want = [(k, min((g for g in grid if g[1] is not None), key=lambda g: ((g[1] - x) ** 2 + (g[2] - y) ** 2, g[0]))[0]) for k, x, y in left if x is not None]
    assert got == sorted(want)
    assert relations.nearest_in_plane(a, b.limit(0), "k", ("x", "y"), ("gx", "gy"), ["i"], "i").count() == 0


def test_nearest_of_odd_places_ends(spark):
    """NaN and infinite places and grid points have no part; very far ones end in a few rounds."""
    nan, inf = float("nan"), float("inf")
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 0.0), (3, 0.0, inf), (4, 1e12, 1e12), (5, -1e200, 3.0), (6, None, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 1.0), (2, nan, nan), (3, inf, 0.0), (4, 5.0, 5.0), (5, -3.0, 2.0)], "i int, gx double, gy double")
    got = {q.k: q.i for q in relations.nearest_in_plane(a, b, "k", ("x", "y"), ("gx", "gy"), ["i"], "i").collect()}
    assert got == {1: 1, 4: 4, 5: 1}  # at 1e200 all distances overflow alike: the first row
    assert relations.nearest_in_plane(a.where("k IN (2, 3, 6)"), b, "k", ("x", "y"), ("gx", "gy"), ["i"], "i").count() == 0
    assert relations.nearest_in_plane(a, b.where("i IN (2, 3)"), "k", ("x", "y"), ("gx", "gy"), ["i"], "i").count() == 0


def test_positions_and_fallbacks(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 2.0, 5.0]), (2, []), (3, None), (4, [7.0])], "k int, a array<double>")
    high = lambda v: v > 4
    got = {q.k: (q.f, q.l, q.i) for q in df.select("k", records.first_where(F.col("a"), high).alias("f"), records.last_where(F.col("a"), high).alias("l"), records.interior(F.col("a")).alias("i")).collect()}
    assert got == {1: (1, 3, [5.0, 2.0]), 2: (None, None, []), 3: (None, None, None), 4: (0, 0, [])}


def test_spectral_batch_of_missing_components(spark):
    a = np.sin(np.arange(120) * 0.3)
    rows = [(1, a.tolist(), (-a).tolist(), a.tolist()), (2, a.tolist(), None, []), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>, c array<double>")
    made = spectra.spectral_batch(df, ["k"], ["a", "b", "c"], 0.01, [0.0, 0.2, 0.7], [0.05, 0.2], 181).collect()
    assert len(made) == 18
    sa = {(q.k, q.damping, q.period): q for q in made}
    one = df.where("k = 1").select(spectra.response_spectrum(F.col("a"), 0.01, [0.0, 0.2, 0.7], 0.2).alias("s")).first().s
    for t, v in zip([0.0, 0.2, 0.7], one):
        assert sa[1, 0.2, t].component_1 == pytest.approx(v) == sa[2, 0.2, t].component_1
        assert sa[1, 0.2, t].rotd100 == pytest.approx(v * np.sqrt(2), rel=1e-6)
        assert sa[2, 0.2, t].rotd50 is None and sa[2, 0.2, t].component_3 is None and sa[3, 0.2, t].component_1 is None
    rot = {(q.period): q for q in spectra.rotated_spectra(df.where("k = 1"), ["k"], "a", "b", 0.01, [0.0, 0.2, 0.7], 0.05, 181).collect()}
    assert all(sa[1, 0.05, t].rotd50 == pytest.approx(q.rotd50) and sa[1, 0.05, t].rotd0 == pytest.approx(q.rotd0, abs=1e-9) for t, q in rot.items())


def test_files_grids_and_progress(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.geojson").write_text("x" * 1024)
    (tmp_path / "in" / "sub" / "b.c.geojson").write_text("y" * 512)
    (tmp_path / "in" / "empty.geojson").write_text("")
    files = {q.name: q.mib for q in readers.read_files(spark, str(tmp_path / "in"), "*.geojson").collect()}
    assert files == {"a": 1 / 1024, "b.c": 1 / 2048}
    lines = ["% remark", *[f" {-30 - i} {-70 - j} 0 0 {10 + i} {i * 3 + j}" for i in range(3) for j in range(4)], ""]
    (tmp_path / "x.fsp").write_text("\n".join(lines))
    patches = readers.read_fault_grid(spark, str(tmp_path / "x.fsp"), 4).collect()
    assert len(patches) == 2 * 3
    first = next(q for q in patches if (q.row, q.column) == (0, 0))
    assert first.slip == (0 + 1 + 4 + 3) / 4 and [tuple(c) for c in first.ring] == [(-70, -30, 10e3), (-71, -30, 10e3), (-71, -31, 11e3), (-70, -31, 11e3)]
    spark.createDataFrame([(1.0, 2.0, float("nan")), (1.0, 3.0, -5.0), (2.0, 3.0, None)], "lon double, lat double, dep double").write.parquet(str(tmp_path / "slab"))
    assert [tuple(q) for q in readers.read_slab(spark, str(tmp_path / "slab")).collect()] == [(1.0, 3.0, -5.0)]
    events = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, n int")
    done = sinks.write_progress(events.where("id = 'c'"), str(tmp_path), "1")
    progress = readers.read_csv(spark, done, "id string, n int")
    assert {q.id for q in readers.to_fetch(events, progress, "id", "n", 2).collect()} == {"b", "d"}
    sinks.merge_sorted_csv(events, spark.createDataFrame([("b", 9), ("0", 5)], "id string, n int"), ["id"], str(tmp_path / "csv"))
    assert [tuple(q) for q in readers.read_csv(spark, str(tmp_path / "csv"), "id string, n int").orderBy("id").collect()] == [("0", 5), ("a", 1), ("b", 9), ("c", 3), ("d", 4)]
