from pyspark.sql import functions as F

from tremorlake.operators import curation, relations


def test_nearest_is_the_same_in_blocks(spark):
    left = spark.createDataFrame([(k, float(k) * 1.7) for k in range(40)], "k int, x double")
    grid = spark.createDataFrame([(g, float(g // 2), None if g == 9 else -float(g)) for g in range(90)], "g int, gx double, deep double")
    distance = F.when(F.col("deep").isNotNull(), F.abs(F.col("x") - F.col("gx")))
    whole = relations.nearest(left, grid, "k", distance, ["g", "deep"], "g").collect()
    parts = relations.nearest(left, grid, "k", distance, ["g", "deep"], "g", block=20).collect()
    assert len(whole) == 40 and sorted(whole) == sorted(parts)
    assert all(r.g == min((g for g in range(90) if g != 9), key=lambda g: (abs(r.k * 1.7 - g // 2), g)) for r in whole)
    assert relations.nearest(left, grid.limit(0), "k", distance, ["g", "deep"], "g").count() == 0


def test_review_sets_the_last_decision(spark):
    state = spark.createDataFrame([("a", "s", 5, "PENDING", None, 1), ("b", "s", 6, "PENDING", None, 2)], "event string, station string, position int, status string, method string, extra int")
    made = spark.createDataFrame(
        [("a", "s", 1, 7, "postponed", False), ("a", "s", 2, 8, "valid", True), ("c", "s", 1, 9, "discarded", None), ("b", "s", 1, 3, "saved", True)],
        "event string, station string, at int, position int, verdict string, moved boolean",
    )
    got = sorted(map(tuple, relations.apply_decisions(state, made, ["event", "station"], "at").collect()))
    assert got == [("a", "s", 8, "VALID", "Manual", 1), ("b", "s", 6, "PENDING", None, 2), ("c", "s", 9, "DISCARDED", "Automatic", None)]


def test_nearest_sample(spark):
    df = spark.createDataFrame([([0.0, 5.0, 1.0, 1.0],), ([],)], "a array<double>")
    got = [r[0] for r in df.select(relations.nearest_sample(F.col("a"), 0.5, F.lit(1.2), F.lit(1.0))).collect()]
    assert got == [2, None]


def test_channels_of_one_name_are_matched_in_many_tasks(spark):
    """The pairs of one station and name do not all come from one task; each comes as often as its rows."""
    files = spark.createDataFrame([(k % 90, 1, "HNE") for k in range(180)] + [(200, 1, None), (201, None, "HNE"), (202, 2, "HNN")], "file int, station int, channel string")
    traces = spark.createDataFrame([(k, 1, "HNE" if k % 2 else "7", "HNE") for k in range(60)] + [(80, 2, "HNN", "HNN"), (81, 1, "HNZ", "HNE"), (82, 2, "7", None)], "trace int, station int, channel string, chan_id string")
    got = curation.match_channels(files, traces, ["station"])
    assert got.columns == ["file", "station", "channel", "trace_channel", "chan_id", "trace"]
    assert sorted((q.file, q.trace) for q in got.collect()) == sorted([(k % 90, t) for k in range(180) for t in range(60)] + [(202, 80)])
    assert max(r[0] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()) < 180 * 60 / 3
