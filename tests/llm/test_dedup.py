import random
import re
from collections import Counter, defaultdict

from tremorlake.llm import components, dedup, queries
from tremorlake.llm.runtime import cut

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute(rows, k, percent):
    sets = [(doc, shingles(t, k)) for doc, t in rows]
    holders = defaultdict(list)
    for i, (doc, s) in enumerate(sets):
        if doc is not None:
            for x in s:
                holders[x].append(i)
    shared = Counter((a, b) for own in holders.values() for n, a in enumerate(own) for b in own[n + 1 :])
    lead = {doc: doc for doc, _ in sets if doc is not None}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((root(sets[a][0]), root(sets[b][0])))
            lead[y] = x
    return Counter((doc, len(s), None if doc is None else root(doc), doc is None or root(doc) == doc) for doc, s in sets)


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op4_minhash_dedup(spark, sf_dir).collect())
    assert got == brute(rows, 4, 80)
    assert any(not r[3] for r in got)


def test_hard_documents(frame, corpus):
    for k in (4, 5):
        spec = dedup.NearDuplicates(shingle=k)
        assert Counter(tuple(r) for r in dedup.near_duplicates(frame(corpus), spec=spec).collect()) == brute(corpus, k, 80)


def test_chains_of_near_copies(frame):
    """Each text differs a little more from the first; ends are linked only through the middle."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words)))
        words = words[:]
        words[step * 16] = f"new{step}"
        words[step * 16 + 8] = f"newer{step}"
    spec = dedup.NearDuplicates(shingle=4)
    assert Counter(tuple(r) for r in dedup.near_duplicates(frame(rows), spec=spec).collect()) == brute(rows, 4, 80)


def test_edges(frame):
    assert dedup.near_duplicates(frame([])).count() == 0
    kept = dedup.drop_near_duplicates(frame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, "")]).withColumnRenamed("lang", "component_id"))
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4} and kept.columns[2] == "component_id"


def test_crowded_band_in_parts(frame):
    """Many texts that are nearly alike, most of them just under the bound, split over parts of their bands."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = base[:]
        for k in r.sample(range(60), r.choice([1, 2, 3])):
            words[k] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[0][1]) for i in range(50)]
    spec = dedup.NearDuplicates(shingle=4, part=4)
    assert Counter(tuple(r) for r in dedup.near_duplicates(frame(rows), spec=spec).collect()) == brute(rows, 4, 80)


def test_five_thousand_near_copies(frame):
    """One large group of near copies, each with a word or two of its own, and as many texts that share half of it."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(5000):
        words = base[:]
        words[r.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(10_000 + i, " ".join(base[:40] + [f"x{i}y{k}" for k in range(40)])) for i in range(500)]
    got = {q.doc_id: q.component_id for q in dedup.near_duplicates(frame(rows), spec=dedup.NearDuplicates(shingle=4)).collect()}
    assert all(got[i] == 0 for i in range(5000)) and all(got[10_000 + i] == 10_000 + i for i in range(500))


def test_components_without_a_last_round(spark, monkeypatch):
    """Against union-find; no round is run only to see that nothing changes: stars are one table, the first."""
    random.seed(8)
    chain, hub = [(k, k + 1) for k in range(40)], [(100, k) for k in range(101, 160)]
    web = [(random.randrange(200, 320), random.randrange(200, 320)) for _ in range(110)]
    schema = "u long, v long"
    for edges, most in ((hub, 1), (hub + [(99, 150)], 3), (chain, 9), (chain + hub + web + hub, 9), ([(5, 5)], 1), ([], 1)):
        tables = []
        monkeypatch.setattr(components, "cut", lambda df: tables.append(cut(df)) or tables[-1])
        got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, schema)).collect()}
        lead = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in lead:
            for u, v in edges:
                if u != v:
                    lead[u] = lead[v] = min(lead[u], lead[v])
        assert got == lead and len(tables) <= most


def test_tables_and_scans_of_a_call(frame, monkeypatch):
    """Every scan, join and stage goes through the driver's memory: tables that rounds share are written once, not joined anew."""
    random.seed(9)
    text = lambda n: [f"w{random.randrange(500)}" for _ in range(n)]
    rows = []
    for g in range(30):
        base = text(120)
        for k in range(20):
            words = list(base)
            for _ in range(k // 2):
                words[random.randrange(120)] = "changed"
            rows.append((100 * g + k, " ".join(words)))
    scans = []

    def counted(df):
        scans.append(df._jdf.queryExecution().sparkPlan().toString().count("FileScan"))
        return cut(df)

    for module in (dedup, components):
        monkeypatch.setattr(module, "cut", counted)
    got = Counter(tuple(r) for r in dedup.near_duplicates(frame(rows)).collect())
    assert got == brute(rows, 5, 80)
    assert max(scans) <= 7 and sum(scans) <= 60, scans
