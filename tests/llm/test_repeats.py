import hashlib
import random
import re
from collections import Counter

import numpy as np

from tremorlake.llm import queries, repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size=35):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - size + 1) if counts[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op10_substring_dedup(spark, sf_dir).collect())
    assert got == brute(rows)
    assert sum(n for (_, _, gone, _), n in got.items() if gone)


def test_hard_documents(frame, corpus):
    for spec in (repeats.Repeats(), repeats.Repeats(block_bytes=1000)):
        found = repeats.remove_repeats(frame(corpus), spec=spec)
        got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found.collect())
        assert got == brute(corpus)


def test_edges(frame):
    assert repeats.remove_repeats(frame([])).count() == 0
    one = frame([(1, "a b")]).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "block")
    row = repeats.remove_repeats(one).first()
    assert (row.n_words, row.n_removed, row.kept_text, row.block) == (2, 0, "a b", "s")


def test_only_hits_of_automata_take_words_away(frame, corpus, monkeypatch):
    docs = frame(corpus)
    rows = repeats.remove_repeats(docs).collect()
    assert sum(r.n_removed for r in rows) > 1000
    assert repeats.streamed(repeats.ahocorasick.Automaton(), [], 35) is None
    spec = repeats.Repeats()
    texts = [[b"%d" % (k % 50) for k in range(120)], [b"x"] * 5 + [b"%d" % k for k in range(40)], [b"y"] * 40]
    data = np.frombuffer(b" ".join(b" ".join(t) for t in texts), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(b" ".join(t)) + 1 for t in texts])
    offsets[-1] -= 1
    w = repeats.Windows(data, offsets, spec)
    automaton = repeats.compiled(w, np.arange(0, 6), texts)
    assert len(automaton) == 2 and repeats.streamed(automaton, texts[1], 35).tolist() == [False] * 5 + [True] * 40
    assert repeats.streamed(automaton, texts[2], 35) is None
    # Numbers 0 to 39 stand at words 0 and 50 of the first text.
    assert np.flatnonzero(repeats.streamed(automaton, texts[0], 35)).tolist() == [*range(40), *range(50, 90)]


def test_equal_rows_and_a_common_anchor(frame):
    """Many copies of one text under one null key, and one line in nearly all documents."""
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    line, copy = text(20), text(90)
    rows = [(None, copy)] * 60 + [(i, f"{text(30)}\n{line}\n{text(30)}") for i in range(300)] + [(7, copy)] * 3
    made = repeats.remove_repeats(frame(rows), spec=repeats.Repeats(block_bytes=400, heavy_blocks=1)).select("doc_id", "n_words", "n_removed", "kept_text")
    assert Counter((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in made.collect()) == brute(rows)
