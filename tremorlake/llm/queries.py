"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import codes, decontaminate, dedup, packing, pii, products, quality, repeats, rules, runs, tokens, urls, warc
from tremorlake.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", quality.fold("doc_id") != 0)
    scored = quality.score_quality(docs, model, threshold=0.3)
    return scored.select("doc_id", (quality.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    headers = F.concat_ws("; ", F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    page = F.floor(F.col("record_id") / 2)
    return resolved.select(
        page.cast("long").alias("page_id"), F.col("url").alias("canonical_url"), F.floor(F.col("refers_to") / 2).cast("long").alias("refers_to"),
        "digest", "outcome", F.when(F.col("headers").isNotNull(), headers).alias("headers"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), spec=dedup.NearDuplicates(shingle=4, percent=80))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, size=2048, end_id=0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), path, limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_quality_rules(table(spark, sf_dir, "documents"), measure_costs=True)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def with_planted_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents; in a tenth of them, by the CRC-32 of the id, words repeat from one word on.

    Other texts, and all with a null id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    placed = held.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    looped = placed.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    words = F.expr("transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE get(w, int(a + (i - a) % p)) END)")
    return looped.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_periodic_runs(with_planted_loops(table(spark, sf_dir, "documents")), least=12)
    best = F.expr("aggregate(runs, cast(null AS " + runs.RUN + "), (b, r) -> CASE WHEN b IS NULL OR r.length > b.length THEN r ELSE b END)")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    totals = codes.with_totals(coded.select("vec_id", "label", code.alias("code"), "error"), "label", "error", "label_error")
    return totals.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.top_products(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_top_products": op13_top_products,
}

ORACLES: dict[str, str] = {}

ORACLES["op2_warc_revisits"] = r"""
WITH p AS (
    SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html,
           regexp_replace(url, '(?s)#.*$', '') AS bare, starts_with(lower(coalesce(url, '')), 'https') AS secure
    FROM pages
),
c AS (
    SELECT *, regexp_extract(bare, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)$', ['s', 'h', 'r']) AS u FROM p
),
d AS (
    SELECT rid, page_id, html, secure, md5(html) AS digest, CASE WHEN secure THEN '"' || left(md5(html), 16) || '"' END AS tag,
           CASE WHEN u.s = '' THEN bare
                ELSE CASE WHEN lower(u.s) = 'http' THEN 'https' ELSE lower(u.s) END || '://'
                     || regexp_replace(lower(u.h), ':(80|443)?$', '') || CASE WHEN starts_with(u.r, '/') THEN '' ELSE '/' END || u.r
           END AS curl
    FROM c
),
j AS (
    SELECT a.page_id, a.curl, a.tag, b.page_id AS found, b.tag AS stored, b.digest, strlen(b.html) AS size,
           row_number() OVER (PARTITION BY a.rid ORDER BY b.page_id DESC NULLS LAST) AS k
    FROM d a LEFT JOIN d b ON a.curl = b.curl AND 10 * b.page_id < 10 * a.page_id + 100005
),
o AS (
    SELECT *, CASE WHEN found IS NULL THEN 'no_earlier_response'
                   WHEN tag IS NOT NULL AND stored IS NOT NULL THEN CASE WHEN tag = stored THEN 'resolved' ELSE 'etag_differs' END
                   WHEN found = page_id THEN 'resolved' ELSE 'date_differs' END AS outcome
    FROM j WHERE k = 1
)
SELECT page_id, curl AS canonical_url, CASE WHEN outcome = 'resolved' THEN found END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN digest END AS digest, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=600; content-length=' || size || '; content-type=text/html; date='
            || (10 * page_id + 100005) || coalesce('; etag=' || coalesce(tag, stored), '') || '; last-modified=day ' || page_id END AS headers
FROM o
"""

ORACLES["op6_url_filter"] = """
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
),
rules(verdict, rhost, rpath) AS (
    VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
           ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
),
fits AS (
    SELECT p.page_id, p.host, p.path, r.verdict, r.rhost || r.rpath AS rule
    FROM parts p
    LEFT JOIN rules r
      ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits
GROUP BY page_id, host, path
"""

ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
    FROM d
),
g AS (
    SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
),
tri AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM g),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM tri) WHERE n >= 2),
cov AS (
    SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS x(o) GROUP BY rid
),
m AS (
    SELECT w.doc_id, w.t, len(ws)::BIGINT AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           len(ls)::BIGINT AS n_lines,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(cov.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cov USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 30 * n_words
            OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * length(regexp_replace(t, '[A-Z]', '', 'g')) < 60 * length(t)
            OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words) AS kept
FROM b
"""

_WHOLE = "SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _code_round(k: int) -> str:
    """Parts with their nearest entries of codebook k, and codebook k + 1."""
    mean = ", ".join(f"floor(sum(part[{i}]) / count(*))" for i in range(1, 9))
    return f"""
a{k} AS MATERIALIZED (
    SELECT rid, pos, any_value(part) AS part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
    FROM (SELECT p.*, entry, list_sum(list_transform(range(1, 9), lambda i: (part[i] - c[i]) * (part[i] - c[i]))) AS d FROM p JOIN b{k} USING (pos)) GROUP BY rid, pos
),
b{k + 1} AS MATERIALIZED (
    SELECT pos, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT pos, entry, [{mean}] AS c FROM a{k} GROUP BY pos, entry) m USING (pos, entry)
),"""


ORACLES["op12_vector_codes"] = f"""
WITH v AS MATERIALIZED ({_WHOLE.format(scale=4096)}),
p AS MATERIALIZED (SELECT rid, vec_id, pos, e[8 * pos + 1 : 8 * pos + 8] AS part FROM v, range(0, 8) r(pos)),
b0 AS MATERIALIZED (SELECT pos, k - 1 AS entry, part AS c FROM (SELECT p.*, row_number() OVER (PARTITION BY pos ORDER BY p.vec_id, e) AS k FROM p JOIN v USING (rid)) WHERE k <= 16),
{"".join(map(_code_round, range(7)))}
f AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY rid),
h AS (SELECT sha256(array_to_string(flatten(list(list_transform(c, lambda x: x::BIGINT) ORDER BY pos, entry)), ',')) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (rid), h
"""

ORACLES["op13_top_products"] = f"""
WITH v AS MATERIALIZED ({_WHOLE.format(scale=1024)}),
s AS (SELECT q.rid AS q, q.vec_id AS query_id, c.rid, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
