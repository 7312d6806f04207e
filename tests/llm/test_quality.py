import tracemalloc

import numpy as np

from tremorlake.llm import quality, queries


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op1_quality_classifier(spark, sf_dir).collect()
    tested = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(tested) > 500 and np.mean([a == b for a, b in tested]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_edges(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "good words here"), (3, "good words here")]).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, "quality", quality.fold("doc_id") >= 0)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 4 and all(r.score > 0.9 for r in got)
    nothing = quality.train(docs, labels.limit(0), "quality", quality.fold("doc_id") >= 0)
    assert quality.score_quality(docs.limit(0), nothing).count() == 0


def test_repeated_rows_and_clashing_names(spark, frame):
    rows = [(i, f"good words {i}" if i % 2 else "# # #") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    keep = quality.fold("doc_id") >= 0
    once = quality.train(frame(rows), labels, "quality", keep)
    again = quality.train(frame(rows * 3 + [(1, None)]).withColumnsRenamed({"lang": "y", "source": "t", "n_chars": "found"}), labels.union(labels), "quality", keep)
    assert quality.score_quality(frame([(1, "good words 1")]), once).first().score > 0.5 > quality.score_quality(frame([(1, "# # #")]), again).first().score


def test_hinge_loss_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    positive = np.array([True, True, False, False] * 5)
    model = quality.fit(rows, positive, buckets=4)
    margins = [model.weights[r].sum() / np.sqrt(2) + model.bias for r in rows]
    assert all((m > 0) == p for m, p in zip(margins, positive))


def test_ratios_against_counting():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 12, r.integers(0, 8))) for _ in range(60)]
    positive = r.random(60) < 0.4
    got = quality.log_count_ratios(rows, positive, 12, alpha=0.5)
    count = lambda f, y: 0.5 + sum(f in row.tolist() for row, p in zip(rows, positive) if p == y)
    share = lambda f, y: count(f, y) / sum(count(g, y) for g in range(12))
    assert np.allclose(got, [np.log(share(f, True) / share(f, False)) for f in range(12)])


def test_no_step_lowers_the_hinge_loss():
    """The loss is convex: where no small step in any direction lowers it, it is least."""
    r = np.random.default_rng(8)
    rows = [np.unique(r.integers(0, 9, r.integers(1, 6))) for _ in range(40)]
    positive, scale, cost = r.random(40) < 0.5, r.normal(0, 1, 9), r.uniform(0.1, 1, 40)
    weights, bias = quality.dual_coordinate_descent(rows, scale, positive, cost, passes=3000)

    def loss(w, b):
        margins = np.array([w[row] @ scale[row] / np.sqrt(len(row)) + b for row in rows])
        return 0.5 * (w @ w + b * b) + cost @ np.maximum(0, 1 - np.where(positive, 1, -1) * margins)

    least = loss(weights, bias)
    for size in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(500):
            step = r.normal(0, size, 10)
            assert loss(weights + step[:9], bias + step[9]) >= least * 0.999
    assert least < loss(np.zeros(9), 0.0)


def test_very_long_and_tied_texts_score_alike(spark, frame):
    """A text of megabytes is scored whole: what stands at its end counts; ties of ids and texts play no part."""
    rows = [(i, f"good words {i}" if i % 2 else "# # #") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(frame(rows), labels, "quality", quality.fold("doc_id") >= 0)
    long = [(1, "good " * 400_000), (1, "good " * 400_000), (2, "good " * 400_000 + "# # #"), (3, "é" * 2_000_000)]
    got = quality.score_quality(frame(long), model).collect()
    by = {}
    for q in got:
        by.setdefault(q.text[-8:], set()).add(q.score)
    assert len(got) == 4 and all(len(v) == 1 for v in by.values()) and len({v.copy().pop() for v in by.values()}) == 3


def test_features_of_texts_without_words():
    """At any place of a batch, the last one too."""
    import pyarrow as pa

    for texts in ([""], [" "], ["a b", ""], ["", "a a a"], ["x", None, " \n", ""], []):
        alone = [next(quality.features(pa.array([t], pa.string()))).tolist() for t in texts]
        assert [f.tolist() for f in quality.features(pa.array(texts, pa.string()))] == alone


def test_ratios_copy_no_rows():
    """Counting takes a few tables of all buckets, not the rows once more."""
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 1 << 16, 4000)).astype(np.int32) for _ in range(500)]
    tracemalloc.start()
    quality.log_count_ratios(rows, r.random(500) < 0.5, 1 << 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 << 20 < sum(row.nbytes for row in rows) // 2
