import inspect
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tremorlake.operators import correction, sampler
from tremorlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    assert got == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name, module, operator, whole",
    [("corrected_records", correction, "correct_records", {"total": 100_000, "burn_in": 10_000}), ("connected_lines", sampler, "connected_lines", {"total": 2000, "most": 10})],
)
def test_chains_are_registered_whole(spark, sf_dir, monkeypatch, name, module, operator, whole):
    plain, calls = getattr(module, operator), []

    def noted(*args, **more):
        bound = inspect.signature(plain).bind(*args, **more)
        bound.apply_defaults()
        calls.append(bound.arguments)
        return plain(*args, **more)

    monkeypatch.setattr(module, operator, noted)
    catalog.QUERIES[name](spark, sf_dir)
    assert [{k: c[k] for k in whole} for c in calls] == [whole]


def test_rotated_spectra_have_the_reference_table(spark, sf_dir):
    rows = catalog.QUERIES["rotated_spectra"](spark, sf_dir).where("vec_id = 2").collect()
    assert len(rows) == 106 * 9 and len({r.period for r in rows}) == 106 and len({r.damping for r in rows}) == 9
    assert all(0 <= r.rotd0 <= r.rotd50 <= r.rotd100 for r in rows)
