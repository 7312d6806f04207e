"""Runs of words, vector codes and product search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import codes, products, queries, runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(w, least):
    """All maximal stretches of each period, smallest period first, so that a multiple of one is no run of its own."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - start >= 2 * p and not any(s <= start and i + p <= s + n for s, n, q in found.values() if p % q == 0):
                found[start, p] = (start, i + p - start, p)
            i += 1
    return sorted((r for r in found.values() if r[1] >= least), key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_op11(doc, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w, 12)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest(lines), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def op11_of(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == COLUMNS
    return Counter(tuple(r) for r in found.collect())


def test_runs_of_symbols_against_brute_force():
    r = random.Random(4)
    for t in range(400):
        texts = [[r.randrange(r.choice([1, 2, 3])) for _ in range(r.choice([0, 1, 5, 40]))] * r.choice([1, 1, 3]) for _ in range(r.randint(0, 4))]
        bounds, least = np.cumsum([0, *map(len, texts)]), r.choice([1, 5, 12])
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(sum(texts, []), dtype=np.int64), bounds, least))))
        assert got == [(a + int(b), n, p) for x, b in zip(texts, bounds) for a, n, p in brute_runs(x, least)]


def test_op11_on_hard_documents(spark, frame, corpus, tmp_path):
    r = random.Random(5)
    rows = [q for q in corpus if len(q[1] or "") < 20_000] + [(100 + k, " ".join(r.choice("ab") for _ in range(60))) for k in range(60)]
    assert op11_of(spark, frame(rows), tmp_path) == Counter(brute_op11(*q) for q in rows)


def test_op11_whole_table(spark, sf_dir, frame, tmp_path):
    rows = [(q.doc_id, q.text) for q in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(q.text or "") < 8000]
    want = Counter(brute_op11(*q) for q in rows)
    assert op11_of(spark, frame(rows), tmp_path) == want and sum(q[1] > 0 for q in want) > 10


def test_runs_of_long_texts_and_odd_tables(frame):
    assert runs.find_periodic_runs(frame([])).count() == 0
    long = " ".join(f"w{k % 7}" for k in range(200_000))
    docs = frame([(1, long), (2, " a\tb\n a b a b a b a b a b c"), (None, None), (2, "")]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "n_words")
    got = runs.find_periodic_runs(docs).orderBy(F.desc("n_words")).collect()
    assert docs.columns[:2] == got[0].__fields__[:2] and [q.n_words for q in got] == [200_000, 13, 0, 0]
    assert [tuple(q) for q in got[0].runs] == [(0, 200_000, 7)] and got[0].collapsed_text == " ".join(f"w{k}" for k in range(7))
    assert [tuple(q) for q in got[1].runs] == [(0, 12, 2)] and got[1].collapsed_text == "a b c" and got[2].collapsed_text == ""


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet{'' if str(folder).startswith('/root') else '/*.parquet'}')")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = queries.QUERIES[name](spark, str(folder))
    assert sorted(found.columns) == sorted(names)
    got = Counter(tuple(q[c] for c in names) for q in found.collect())
    assert got == Counter(cursor.fetchall())
    return sum(got.values())


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_top_products"])
def test_vectors_same_as_sql(spark, sf_dir, name, tmp_path):
    assert same_as_sql(spark, name, sf_dir)
    r = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(x) for x in r.normal(0, 0.1, 64)], k % 5) for k in range(300)] + [(400 + k, [0.125] * 64, None) for k in range(200)]
    rows += [(900, None, 1), (901, [None] + [0.1] * 63, 1), (902, [nan] * 64, 2), (903, [inf] * 64, 2), (904, [0.0] * 64, None), (1000, [-0.5] * 64, 3), (1100, [40.0] * 64, 3)]
    vectors(spark, rows).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same_as_sql(spark, name, tmp_path)


def test_codes_of_odd_tables(spark):
    none, books = codes.compress_vectors(vectors(spark, []))
    assert none.count() == 0 and books.size == 0
    rows = [(None, [1.0] * 8, 1), (5, [2.0] * 8, None), (5, [1.0] * 8, 1), (7, [3.0] * 16, 1), (8, [], 1), (5, [2.0] * 8, 1), (9, [1e30] * 8, 1), (10, [1.0] * 7, 2)]
    made, books = codes.compress_vectors(vectors(spark, rows).withColumnRenamed("label", "error"), spec=codes.Codes(rounds=0))
    assert books[0].ravel().tolist() == [4096, 8192, 8192, codes.LARGEST, 4096] and made.columns == ["vec_id", "embedding", "codes", "error"]
    assert Counter((q.vec_id, tuple(q.codes), q.error) for q in made.collect()) == Counter({(None, (0,) * 8, 0): 1, (5, (0,) * 8, 0): 1, (5, (1,) * 8, 0): 2, (9, (3,) * 8, 0): 1})
    totals = codes.with_totals(spark.createDataFrame([(None, 1), (None, 2), (1, 1 << 62), (1, 1 << 62), (2, 5)], "label int, error long"), "label", "error", "t")
    assert Counter(tuple(q) for q in totals.collect()) == Counter([(None, 1, 3), (None, 2, 3), (1, 1 << 62, None), (1, 1 << 62, None), (2, 5, 5)])


def brute_products(rows, is_query, k, scale=1024):
    whole = [(i, key, [int(np.floor(scale * float(x))) for x in v]) for i, (key, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, key, q in whole:
        if is_query(key):
            scores = [(-sum(a * b for a, b in zip(q, v)), other is None, other or 0, other) for j, other, v in whole if j != i]
            out += [(key, n, other, -s) for n, (s, _, _, other) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def test_products_against_brute_force(spark):
    """Lengths of many sizes, copies of a query, null and repeated keys, ties, vectors of other lengths, blocks of queries."""
    r = np.random.default_rng(6)
    rows = [(int(k), [float(x) for x in r.normal(0, 1, 6) * s], 0) for k, s in enumerate(np.geomspace(0.01, 5, 400))]
    rows += [(20, rows[20][1], 0), (None, rows[40][1], 0), (500, [0.0] * 6, 0), (520, [], 0), (540, [1.0, 2.0], 0), (560, None, 0), (-20, [-1.0] * 6, 0), (580, [float("nan")] * 6, 0), (600, [1.0] * 9, 0), (None, rows[40][1], 0)]
    df = vectors(spark, rows).repartition(4)
    want = brute_products(rows, lambda key: key is not None and key % 20 == 0, 7)
    for at_once in (4096, 5):
        made = products.top_products(df.withColumnRenamed("label", "score"), "vec_id % 20 = 0", k=7, queries_at_once=at_once)
        assert made.columns == ["query_id", "rank", "vec_id", "score"] and Counter(tuple(q) for q in made.collect()) == want
    assert products.top_products(df.limit(0), "vec_id % 20 = 0").count() == 0 and products.top_products(df, "vec_id = 7777").count() == 0
    assert products.top_products(df.where("vec_id = 20").limit(1), "true").count() == 0


def test_all_ways_of_pruning_are_taken():
    """Short vectors are left out, vectors of skewed directions go by coordinates, even ones by length; nothing is lost."""
    r = np.random.default_rng(7)
    sharp = np.eye(8, dtype=np.int64)[r.integers(0, 8, 4000)] * r.integers(300, 1000, 4000)[:, None] + r.integers(-9, 9, (4000, 8))
    even = r.integers(-600, 600, (2000, 8))
    v = np.concatenate([sharp, even, even // 90])
    v = v[np.argsort(-(v**2).sum(axis=1), kind="stable")]
    q = np.concatenate([sharp[:20], even[:20]])
    searcher = products.Searcher({"row": np.arange(-len(q), 0), "vectors": q, "least": np.full(len(q), products.NONE)}, 10)
    found = {}
    for k in range(0, len(v), 1000):
        n = np.arange(k, min(k + 1000, len(v)))
        bucket = products.Bucket(n, np.ones(len(n), dtype=bool), n, v[n])
        for a, row, _, score in searcher.search(bucket):
            found.setdefault(a + len(q), []).append((-score, row))
    assert all(searcher.ways)
    for query in range(len(q)):
        scores = v @ q[query]
        assert sorted(found[query])[:10] == sorted((-int(s), i) for i, s in enumerate(scores))[:10]
