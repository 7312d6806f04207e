import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import decontaminate, pii, queries, rules, urls

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_counts(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return (
        len(list(EMAIL.finditer(text))),
        sum(all(int(p) <= 255 for p in m.group().split(".")) for m in IP.finditer(text)),
        sum(12 <= len(digits(m)) <= 19 and luhn(digits(m)) for m in CARD.finditer(text)),
        sum(9 <= len(digits(m)) <= 15 for m in PHONE.finditer(text)),
    )


def test_personal_data_base_matches(spark, sf_dir, frame):
    hard = ["a@b.c x@y", "a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-9", "+1 (650) 555-0123 +1", None, "", "🙂 a.b@c.de 🙂 0.0.0.0"]
    rows = list(enumerate(hard)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find_personal_data(frame(rows)).collect()}
    assert got == {i: base_counts(t or "") for i, t in rows}


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_personal_data_spans_against_brute_force(spark, sf_dir, frame):
    r = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (650) 555-0123", "+12", " ", " é", "🙂", ".", "-", "5500005555555559", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(300, None), (301, ""), (None, "a@b.c"), (301, "")]
    rows += [(400 + q.doc_id, q.text) for q in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = pii.find_personal_data(frame(rows)).collect()
    want = Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((q.doc_id, q.base_sha256) for q in got) == want
    texts = dict(rows)
    for q in got:
        base, spans = base_spans(texts[q.doc_id] or ""), q.spans.split(",")
        assert not base or set(base.split(",")) <= set(spans)
        for f in q.found:
            assert (texts[q.doc_id].encode()[f.first : f.last]).decode() == texts[q.doc_id][f.start : f.end]


def test_long_texts_of_every_shape(frame):
    """Repeats of each part of each pattern, alone and as one long span: Java's matcher must not recurse, which 40 KB show."""
    starts = {"email": "a@b", "loose": "x [at] b", "ip": "1.2.3", "card": "4111", "phone": "+49", "none": ""}
    units = [".b", " (dot) b", "[dot]b", "a", "b1", "@a", "a@b.c ", "1", ".1", "1.2.3.4 ", "[.]1", "-1", " 1", "(1)", "+1", "(", "4111.1111.", "4111 1111 1111 1111 ", "00", "555-", "(555) ", "\n", "é"]
    rows = list(enumerate(s + u * (60_000 // len(u)) for s in starts.values() for u in units))
    got = {q.doc_id: q for q in pii.find_personal_data(frame(rows)).select("doc_id", "n_email", "n_ip", "n_phone").collect()}
    assert len(got) == len(rows)
    assert next(got[i] for i, t in rows if t.startswith("a@b.b.b")).n_email == 1
    assert next(got[i] for i, t in rows if t.startswith("a@b.c a@b.c")).n_email == 60_000 // 6
    clean = pii.redact(frame([(1, "x [at] b" + ".b" * 500_000), (2, "a@b" + ".b" * 500_000)])).orderBy("doc_id").collect()
    assert clean[1].text == "<EMAIL>" and clean[0].text in ("<EMAIL>", "x [at] b" + ".b" * 500_000)


def test_the_vote_adds_true_spans_and_refuses_false_ones(frame):
    r = random.Random(7)
    octet, number = lambda: r.randint(1, 254), lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(6))

    def card(sep):
        while True:
            d = "4" + number(15)
            if luhn(d):
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def wrong(sep):
        while True:
            d = "9" + number(15)
            if not luhn(d):
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    rows, true, false = [], {}, {}
    for i in range(0, 1200, 6):
        plain = f"mail {name()}@{name()}.com or call +1 {number(3)} {number(3)} {number(4)}, server {octet()}.{octet()}.{octet()}.{octet()}, card {card(' ')}; version {number(3)}.{number(3)}.{number(3)}.{number(3)} order {wrong(' ')}"
        for k, (kind, good, bad) in enumerate([
            ("email", f"{name()} (at) {name()} [dot] com", f"{name()} (at) {name()}.{name()}"),
            ("ip", f"{octet()}[.]{octet()}[.]{octet()}[.]{octet()}", f"{r.randint(300, 999)}[.]{octet()}[.]{octet()}[.]{r.randint(300, 999)}"),
            ("card", card("/"), wrong("/")),
        ]):
            rows += [(i + 2 * k, f"{plain} {name()} {name()} {name()} {'mail' if kind == 'email' else 'host' if kind == 'ip' else 'card'} {good} {name()}"), (i + 2 * k + 1, f"{name()} {name()} {name()} {name()} section {bad} {name()}")]
            true[i + 2 * k], false[i + 2 * k + 1] = (kind, good), bad
    got = {q.doc_id: q for q in pii.find_personal_data(frame(rows)).collect()}
    texts = dict(rows)
    spans = {i: {texts[i][f.start : f.end] for f in q.found} for i, q in got.items()}
    for kind in ("email", "ip", "card"):
        of_kind = [(i, good) for i, (k, good) in true.items() if k == kind]
        assert sum(good in spans[i] for i, good in of_kind) > 0.95 * len(of_kind), kind
    assert sum(bad in spans[i] for i, bad in false.items()) < 0.05 * len(false)
    clean = {q.doc_id: q.text for q in pii.redact(frame(rows)).collect()}
    assert all(good not in clean[i] for i, (k, good) in true.items() if good in spans[i]) and all(clean[i] == texts[i] for i in false if not spans[i])


def test_personal_data_edges(frame):
    """Clashing columns stay, repeats are alike, an empty table gives none, time grows with the number of matches."""
    docs = frame([(1, "x a@b.c +1 650 555 0123 y"), (1, "x a@b.c +1 650 555 0123 y"), (2, None)]).withColumnsRenamed({"lang": "__text", "source": "__found", "n_chars": "spans"})
    made = pii.find_personal_data(docs)
    assert made.columns == ["doc_id", "text", "__text", "__found", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
    rows = [tuple(q) for q in made.where("doc_id = 1").collect()]
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0][2:4] == ("en", "s")
    assert {q.text for q in pii.redact(docs).collect()} == {"x <EMAIL> <PHONE> y", None} and pii.redact(docs).columns == docs.columns
    assert pii.find_personal_data(docs.limit(0)).count() == pii.redact(docs.limit(0)).count() == 0
    many = frame([(1, "é" + " ".join(f"u{i}@h{i}.com" for i in range(20_000)))])
    assert pii.find_personal_data(many).first().n_email == 20_000
    assert pii.redact(many).first().text == "é" + " ".join(["<EMAIL>"] * 20_000)


def test_redaction_keeps_rows_and_columns(frame):
    docs = frame([(1, "mail me: a.b@c.de now"), (2, None), (2, "")])
    made = pii.redact(docs)
    assert made.columns == docs.columns and {r.text for r in made.collect()} == {"mail me: <EMAIL> now", None, ""}


def test_rules_on_hard_documents(frame, corpus):
    got = rules.apply_quality_rules(frame(corpus)).collect()
    assert len(got) == len(corpus) and all(r.base_failed for r in got if r.n_words < 50)
    assert rules.apply_quality_rules(frame([])).count() == 0


def test_later_rules_are_not_evaluated_for_rejected_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = rules.QualityRule("first", "n_words >= 50", weight=1.0)
    costly = rules.QualityRule("costly", "isnotnull(raise_error('reached'))", weight=1e9)
    made = rules.measured(docs).selectExpr(f"{rules.verdict_sql([first, costly])} AS failed").collect()
    assert {r.failed for r in made} == {"base", "first"}
    with pytest.raises(Exception, match="reached"):
        rules.measured(docs).selectExpr(f"{rules.verdict_sql([costly, first])} AS failed").collect()


def test_order_of_rules(spark, frame, sf_dir):
    """By rejections per cost over a sample of all rows; the same in every call and for every verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half, all_of = rules.QualityRule("half", "n_words % 2 = 0"), rules.QualityRule("all", "true", "length(__text)", 1.0)
    sample = rules.sampled(docs, "doc_id", 50)
    assert 20 < sample.count() < 100 and sample.count() == rules.sampled(docs.orderBy("n_chars"), "doc_id", 50).count()
    assert [r.name for r in rules.cascade_order(sample, (all_of, half))] == ["half", "all"]
    assert [r.name for r in rules.cascade_order(sample, (half, rules.QualityRule("also", "n_words % 2 = 0")))] == ["also", "half"]
    assert all(r.weight > 0 for r in rules.timed(sample, rules.RULES, repeats=1))
    assert 0 < rules.apply_quality_rules(docs).where('kept').count() < docs.count()
    one, two = ({r.doc_id: r.failed_rule for r in rules.apply_quality_rules(d).collect()} for d in (docs, docs.orderBy("text")))
    assert one == two
    turned = {r.doc_id: r.kept for r in rules.apply_quality_rules(docs, rules.RULES[::-1], sample_rows=3).collect()}
    assert turned == {i: v is None for i, v in one.items()}


def test_rules_with_clashing_columns_and_repeated_rows(frame, corpus):
    docs = frame(corpus).withColumnsRenamed({"lang": "__text", "source": "__words", "n_chars": "n_words"})
    made = rules.apply_quality_rules(docs)
    assert made.columns == ["doc_id", "text", "__text", "__words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept"]
    same = [r for r in made.collect() if r.doc_id == 23]
    assert len(same) == 2 and same[0] == same[1]


def test_leaks_with_edits(spark, frame):
    item = " ".join(f"word{i} thing" for i in range(20))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    edited = item.replace("word3", "wxrd3").replace("word9 ", "word9, ")
    docs = frame([(1, "x " * 50 + edited + " tail"), (2, "clean text " * 30), (3, None), (4, "")])
    assert {r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()} == {1}
    assert {r.doc_id for r in decontaminate.drop_leaking(docs, bench).collect()} == {2, 3, 4}


def least_edits(pattern, text):
    """Least edits of the pattern to any part of text (Sellers), for each row of `pattern`."""
    cost = np.repeat(np.arange(pattern.shape[1] + 1)[None], len(pattern), 0)
    best = cost[:, -1].copy()
    for symbol in text:
        new = np.zeros_like(cost)
        new[:, 1:] = np.minimum(cost[:, :-1] + (pattern != symbol), cost[:, 1:] + 1)
        steps = np.arange(cost.shape[1])
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, cost[:, -1])
    return best


def leaks(item, text, matching):
    body = np.frombuffer(item.encode(), dtype=np.uint8)
    for size in {min(len(body), matching.short), min(len(body), matching.piece)}:
        pieces = np.lib.stride_tricks.sliding_window_view(body, size)
        if least_edits(pieces, np.frombuffer(text.encode(), dtype=np.uint8)).min() <= matching.budget(size):
            return True
    return False


def test_partial_passages_against_brute_force():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(1, text(60)), (2, text(16)), (3, text(6)[:40])]
    matching = decontaminate.Matching()
    index = decontaminate.PieceIndex(items, matching)
    passages = [items[0][1][at : at + 50].strip() for at in range(len(items[0][1]) - 49)]
    for _ in range(120):
        item = r.choice(items)[1]
        at, size = r.randrange(len(item)), r.randint(30, 140)
        part = list(item[at : at + size])
        for _ in range(r.randint(0, 8)):
            k = r.randrange(len(part) + 1)
            part[k : k + r.randint(0, 1)] = r.choice(["", "k", "kl"])
        passages.append(" ".join("".join(part).split()))
    texts = [f"{text(4)} {p} {text(4)}" for p in passages] + passages + items[1][1].split()
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [set(found) for found in index.occurrences(np.frombuffer("".join(texts).encode(), dtype=np.uint8), edges)]
    want = [{k for k, item in items if leaks(item, t, matching)} for t in texts]
    assert got == want and 20 < sum(not w for w in want[len(passages) - 120 : len(passages)]) < 100


def test_leaks_by_blocks_of_the_benchmark(spark, frame):
    items = [(i, " ".join(f"{w}{k} thing" for k in range(12))) for i, w in enumerate(["word", "term", "name", "part", "case"])] + [(9, "tie x"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame([(100 + i, f"some text {t} more") for i, t in items] + [(1, "clean text " * 20), (2, None), (3, items[0][1] + items[3][1])])
    one, many = ({(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_bytes=b).collect()} for b in (1 << 20, 100))
    assert one == many and {(3, 0), (3, 3)} <= one and len(one) == 8
    kept = [sorted(r.doc_id for r in decontaminate.drop_leaking(docs, bench, block_bytes=b).collect()) for b in (1 << 20, 100)]
    assert kept == [[1, 2, 110]] * 2


def test_leaks_of_repeated_rows(spark, frame):
    """Rows of the benchmark with equal or null ids are items of their own, rows of documents too."""
    a, b = (" ".join(f"{w}{i} thing" for i in range(20)) for w in ("word", "term"))
    bench = spark.createDataFrame([(1, a), (1, b), (None, a), (None, b), (2, "tie x"), (2, "tie x")], "item_id long, text string").withColumn("start", F.lit(0))
    docs = frame([(5, a + " " + b), (5, a), (None, "see tie x.")]).withColumnsRenamed({"lang": "edits", "source": "item_id"})
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == {(5, 1): 3, (5, None): 3, (None, 2): 2}
    assert decontaminate.drop_leaking(docs, bench).count() == 0 and decontaminate.drop_leaking(docs, bench.limit(0)).count() == 3
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_part_of_an_item_and_short_items(spark, frame):
    item = " ".join(f"word{i} thing" for i in range(20))
    bench = spark.createDataFrame([(1, "Two words"), (2, "x"), (3, "日本"), (4, item)], "item_id long, text string")
    docs = frame([(1, "see: TWO  words."), (2, "two wordsmith"), (3, "x"), (4, "axe"), (5, "の日本の"), (6, "two"), (7, "words"), (8, " ".join(item.split()[5:18]))])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 1), (3, 2), (5, 3), (8, 4)}


def fitting(rules, host, path):
    """The longest rule that fits, by the words of the contract."""
    fits = [r for r in rules if r.host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: r.rank, default=None)
    return (best.text, best.verdict) if best else (None, "allow")


def test_url_rules_against_brute_force(spark):
    r = random.Random(4)
    label, segment = lambda: r.choice(["a", "b", "com", "x-y", ""]), lambda: r.choice(["", "en", "e", "7", "e/n"])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 3)))
    made = [urls.Rule(r.choice(["allow", "block"]), host(), r.choice(["", "/", "en/", "/" + segment(), "/" + segment() + "/" + segment()])) for _ in range(60)]
    made.append(urls.Rule("block", "com", "en/"))
    rows = [(i, f"http://{host().upper()}{r.choice(['', '/'])}{'/'.join(segment() for _ in range(3))}{r.choice(['', '?q', '#f'])}") for i in range(400)]
    rows += [(400, "http://a.com/en/x"), (401, "http://a.com/" + "en/" * 20000), (402, None), (403, "no url"), (403, "no url")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumnRenamed("page_id", "judged").selectExpr("*", "1 AS verdict", "2 AS lead", "3 AS b")
    table = spark.createDataFrame([(x.verdict, x.host, x.path) for x in made], "verdict string, host string, path string")
    one, two, three = (
        sorted((p.judged, p.host, p.path, p.rule or "", p.verdict) for p in urls.filter_urls(pages, *more).collect())
        for more in ((made,), (table,), (table, "url", "allow", 0))
    )
    assert one == two == three and len(one) == len(rows)
    assert all((rule or None, verdict) == fitting(made, host, path) for _, host, path, rule, verdict in one)
    assert urls.filter_urls(pages, made).columns == ["judged", "url", "lead", "b", "host", "path", "rule", "verdict"]
    assert urls.filter_urls(pages.limit(0), made).count() == urls.filter_urls(pages.limit(0), table, max_broadcast_bytes=0).count() == 0


def test_op6_verdicts_of_its_contract(spark, tmp_path):
    """Every rule's word in the contract's list, at its host, at a subdomain and beside it."""
    judged = {
        "http://com/en/": ("com/en/", "block"),
        "https://A.Example.COM/en/6?q": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://www.example.com/en/70#f": ("example.com/en/7", "allow"),
        "http://anexample.com/en/7": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"),
        "http://m.example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://m.example.net/de/81": ("example.net/de/8", "block"),
        "http://anexample.net/de/8": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"),
        "http://a.b.org/es/x": ("org/es/", "block"),
        "http://a.org/ES/x": (None, "allow"),
        "http://a.net/en/7": (None, "allow"),
        "net/de/8": (None, "allow"),
        None: (None, "allow"),
    }
    rows = [(i, u, "") for i, u in enumerate(judged)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(judged.values()))
    contract = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert [(r.verdict, r.text) for r in queries.URL_RULES] == contract
