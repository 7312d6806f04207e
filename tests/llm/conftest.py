import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of given (doc_id, text) rows."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return made


@pytest.fixture(scope="session")
def corpus():
    """Small hard documents: copies, near copies, shared passages, nulls, empty, very long, ties, repeated rows."""
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Étude", "naïve", "日本", "a"]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    base, passage = text(300), text(60)
    near = base.split()
    near[150] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, base), (7, base), (8, " ".join(near)), (9, base.upper())]
    rows += [(10 + k, text(80) + " " + passage + "\n" + text(50)) for k in range(4)]
    rows += [(20, text(20000)), (21, "x " * 500), (22, "x " * 40 + "y " * 40), (23, base), (23, base), (24, passage), (25, text(34)), (26, "a b c d " * 30)]
    rows += [(None, base), (None, "tiny"), (30, text(35)), (31, "  ".join(passage.split()[:36])), (32, " ".join(passage.split()[:34]))]
    return rows
