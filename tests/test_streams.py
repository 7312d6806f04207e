"""Streams that keep keyed tables: merged catalogues and review states."""

import os
import random

import pytest

from tremorlake.streaming.keyed import KeyedTable, arriving, merge_catalogue, newest
from tremorlake.streaming.review import keep_reviews, review_states

CATALOGUE = "id string, stations string, magnitude double, n long"


def arrive(spark, folder, files, schema, start=0):
    """One Parquet file for each list of rows, in their order."""
    seen = set(folder.glob("*.parquet")) if folder.exists() else set()
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - seen:
            os.utime(f, (1e9 + start + k, 1e9 + start + k))
            seen.add(f)


def files_of(folder):
    return {str(p.relative_to(folder)) for p in (folder / "data").rglob("*.parquet")}


def test_catalogue_unites_lists_and_keeps_untouched_files(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("id",), 16)
    run = lambda: merge_catalogue(arriving(spark, str(tmp_path / "in"), CATALOGUE), table, "n", ("stations",), str(tmp_path / "cp")).awaitTermination()
    first = [(f"e{k}", "B; A", float(k), 1) for k in range(40)] + [(None, "X", None, 1)]
    arrive(spark, tmp_path / "in", [first], CATALOGUE)
    run()
    before = files_of(tmp_path / "t")
    assert len(before) == len(table.read(spark).select(table.bucket()).distinct().collect()) > 8
    arrive(spark, tmp_path / "in", [[("e3", "C", 9.0, 2), ("e3", "D; C", 8.0, 1)]], CATALOGUE, 1)
    run()
    after = files_of(tmp_path / "t")
    assert len(after - before) == 1 and len(before - after) == 0  # the one replaced stays for a restart
    arrive(spark, tmp_path / "in", [[("e3", "", 7.0, 1)], [("new", None, 1.0, 5), (None, "Y", 2.0, 3)]], CATALOGUE, 2)
    run()
    got = {q.id: (q.stations, q.magnitude, q.n) for q in table.read(spark).collect()}
    assert got["e3"] == ("A; B; C; D", 9.0, 2) and got["new"] == ("", 1.0, 5) and got[None] == ("X; Y", 2.0, 3)
    assert len(got) == 42 and got["e7"] == ("A; B", 7.0, 1)
    untouched = {f for f in before if f in files_of(tmp_path / "t")}
    assert len(untouched) >= len(before) - 3
    assert len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 2


def test_a_batch_that_runs_again_gives_the_same_table(spark, tmp_path):
    table, combine = KeyedTable(str(tmp_path / "t"), ("id",), 4), newest(("id",), "n", ("stations",))
    made = lambda rows: spark.createDataFrame(rows, CATALOGUE)
    table.merge(made([("a", "S", 1.0, 1), ("b", "S", 1.0, 1)]), 0, combine)
    for _ in range(2):
        table.merge(made([("a", "T", 2.0, 2)]), 1, combine)
    table.merge(made([]), 2, combine)
    assert {tuple(q) for q in table.read(spark).collect()} == {("a", "S; T", 2.0, 2), ("b", "S", 1.0, 1)}
    assert KeyedTable(str(tmp_path / "none"), ("id",)).read(spark) is None


DECISIONS = "event string, station string, at long, position long, verdict string, moved boolean"


@pytest.mark.parametrize("seed", [1])
def test_reviews_in_any_order_across_restarts(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [
        (f"e{r.randrange(4)}", r.choice(["s1", "s2", None]), r.choice([None, *range(30)]), r.choice([None, 5, 6]), r.choice(["valid", "valid", "discarded", "postponed", "corrected", "kept", None]), r.choice([True, False, None]))
        for _ in range(120)
    ]
    rows += rows[:30]
    r.shuffle(rows)
    files = [rows[k : k + 25] for k in range(0, len(rows), 25)]
    table = KeyedTable(str(tmp_path / "t"), ("event", "station"), 8)
    run = lambda: keep_reviews(arriving(spark, str(tmp_path / "in"), DECISIONS), table, str(tmp_path / "cp")).awaitTermination()
    for k in range(0, len(files), 3):  # each call goes on from the checkpoint of the last
        arrive(spark, tmp_path / "in", files[k : k + 3], DECISIONS, k)
        run()
    run()
    want = review_states(spark.createDataFrame(rows, DECISIONS), ["event", "station"])
    got = table.read(spark)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("corrected").count() >= 1 and got.where("changes > 1").count() >= 1


def test_reviews_are_kept_by_an_aggregate(spark, tmp_path):
    """No row of a stream of decisions goes through Python; a pick's changes count what its batches changed."""
    table = KeyedTable(str(tmp_path / "t"), ("event", "station"), 4)
    rows = [[("a", "s", None, 1, "valid", None), ("b", "s", 9, 1, "corrected", None), ("c", None, 1, None, "discarded", True)], [("a", "s", 5, 1, "valid", None)] * 3, [("a", "s", 3, 2, "postponed", True)], [("a", "s", 8, 2, "corrected", None)], [("b", "s", 2, 4, "valid", False)]]
    arrive(spark, tmp_path / "in", rows, DECISIONS)
    query = keep_reviews(arriving(spark, str(tmp_path / "in"), DECISIONS), table, str(tmp_path / "cp"))
    query.awaitTermination()
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"}
    got = {q.event: (q.changes, q.at, q.position, q.status, q.method, q.corrected) for q in table.read(spark).collect()}
    assert got == {"a": (2, 5, 1, "VALID", "Automatic", True), "b": (1, 2, 4, "VALID", "Automatic", True), "c": (1, 1, None, "DISCARDED", "Manual", False)}
