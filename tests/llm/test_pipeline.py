import os
from collections import defaultdict

import corpus_pipeline
import numpy as np
from test_dedup import brute
from test_tokens import check_packing

from tremorlake.llm import decontaminate, pii
from tremorlake.llm.runtime import shared_folder


def test_stages_over_the_table(spark, sf_dir):
    """Each stage on what its predecessor kept: columns stay, decisions take effect, against brute force where there is one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept[-1], sf_dir).cache()
        made.count()
        kept.append(made)
    good, single, unleaked, redacted, packed = kept[1:]
    assert all(k.columns == docs.columns for k in kept[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "personal data", "best-fit packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = ids(docs) & set(labels), ids(good)
    assert np.mean([(i in after) == (labels[i] == 1) for i in before]) > 0.95
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert ids(single) == {doc for doc, _, _, stays in brute(rows, 5, 80) if stays}
    index = decontaminate.PieceIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], decontaminate.Matching())

    def leaks(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        body, edges, _ = decontaminate.normalised(data, np.array([0, len(data)]))
        return bool(index.occurrences(body, edges)[0])

    assert ids(unleaked) == {r.doc_id for r in single.collect() if not leaks(r.text)} and ids(unleaked) < ids(single)
    texts = {r.doc_id: r for r in redacted.collect()}
    assert set(texts) == ids(unleaked) and all(r.n_chars == len(r.text) for r in texts.values())
    for r in pii.find_personal_data(unleaked).collect():
        assert (r.text == texts[r.doc_id].text) == (not r.found)
        assert all(r.text[f.start : f.end] not in texts[r.doc_id].text or f.end - f.start < 8 for f in r.found)
    used, least = check_packing(packed.collect(), {i: r.text for i, r in texts.items()}, 2048)
    assert least <= used <= least * 1.01 + 1


def test_whole_run_leaves_one_table(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    sums = defaultdict(int)
    for r in rows:
        sums[r.sequence_id] += r.length
    assert rows and max(sums.values()) <= 2048
    folder = shared_folder(spark).removeprefix("file:")
    assert [sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("corpus-")] == [["4"]]


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, sequence_id string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_over_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, copies, repeated rows, a column named as one of the packing; then no documents at all."""
    words = " ".join(f"word{k}" for k in range(90))
    leak = "the planted passage of a benchmark item that nobody should ever train on"
    docs = [
        (1, None, None, None, None, None), (2, "", "en", "s", 0, "x"), (3, words, "en", "s", 9, "x"), (4, words, None, "s", 9, "x"), (None, words + " of no id", "en", "s", 9, "x"),
        (5, f"{words[::-1]} {leak} {words[::-1]}", "en", "s", 9, "x"), (6, "write to a.b@c.de now", "en", "s", 9, "x"), (6, "write to a.b@c.de now", "en", "s", 9, "x"), (7, " ".join(f"long{k}" for k in range(60_000)), "en", "s", 9, "x"),
    ]
    tables(spark, tmp_path / "a", docs, [], [(1, leak), (None, None), (2, "")])
    got = defaultdict(list)
    for q in corpus_pipeline.run(spark, str(tmp_path / "a")).collect():
        got[q.doc_id].append(q.length)
    assert set(got) == {1, 2, 3, 6, 7, None} and got[1] == got[2] == [1] and len(got[6]) == 2 and sum(got[7]) > 60_000 and max(got[7]) == 2048
    tables(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
