"""Quality rules as a short-circuit cascade over built-in functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.runtime import cut, drop_cut, plain_names

#: Documents on which costs and selectivities are estimated, about: those of the least hashes of their keys.
SAMPLE_ROWS = 4096

_WHITE = r" \u0009\u000A\u000B\u000C\u000D"

#: The words `[^\x20\x09-\x0D]+` of column __text.
WORDS = rf"""CASE WHEN length(trim(BOTH '{_WHITE}' FROM __text)) = 0 THEN cast(array() AS array<string>)
    ELSE split(trim(BOTH '{_WHITE}' FROM __text), '[\\x20\\x09-\\x0D]+', -1) END"""

#: Words of `__words` inside a 3-word window that occurs twice or more. The windows are hashed;
#: only where two are equal are they sorted with their places to find which words they cover.
#: The words are bound once, so that a condition on the result never splits them anew for each.
REPEATED = """element_at(transform(array(__words), w -> CASE WHEN size(w) < 4 THEN 0L ELSE element_at(transform(array(transform(
    sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))),
    t -> CASE WHEN size(array_distinct(t)) = size(t) THEN 0L ELSE element_at(transform(array(
        sort_array(transform(t, (k, i) -> named_struct('k', k, 'i', i)))),
        s -> cast(size(array_distinct(flatten(transform(
            filter(s, (e, j) -> coalesce(get(s, j - 1).k = e.k, false) OR coalesce(get(s, j + 1).k = e.k, false)),
            e -> array(e.i, e.i + 1, e.i + 2))))) AS bigint)), 1) END), 1) END), 1)"""

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRule:
    """`fails` is an SQL condition over __text, __words, __lines and the base measures; a document that meets it is rejected.

    What it needs beside these belongs into the condition, so that it is evaluated only where the rule is reached.
    `work` is an SQL expression for the units of work that it takes for a document, `weight` the nanoseconds for each.
    """

    name: str
    fails: str
    work: str = "1"
    weight: float = 20.0


#: The rules beside the base; thresholds in hundredths so that all arithmetic is exact. Weights are what `timed` once
#: gave: a comparison of measures that the base has made anyway, or passes over the text; a call times them anew on its sample.
RULES = (
    QualityRule("symbols", "100 * n_symbols > 30 * n_words"),
    QualityRule("duplicate_lines", "size(__lines) >= 4 AND 100 * n_dup_lines > 30 * size(__lines)"),
    QualityRule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    QualityRule("shouting", "100 * length(translate(__text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) < 60 * length(__text)", "length(__text)", 15.0),
    QualityRule("exclamation", "2 * (length(__text) - length(replace(__text, '!', ''))) > n_words", "length(__text)", 3.0),
)

#: The base measures.
MEASURES = {
    "n_words": "cast(size(__words) AS bigint)",
    "word_chars": rf"cast(length(translate(__text, '{_WHITE}', '')) AS bigint)",
    "n_symbols": f"cast(length(__text) - length(translate(__text, '{SYMBOLS}', '')) AS bigint)",
    "n_dup_lines": "cast(size(__lines) - size(array_distinct(__lines)) AS bigint)",
    "n_repeat_words": f"cast({REPEATED} AS bigint)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add __text, __words, __lines, the base measures and base_failed."""
    lines = rf"filter(split(__text, '\n', -1), l -> length(trim(BOTH '{_WHITE}' FROM l)) > 0)"
    raw = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    cut_up = raw.withColumns({"__words": F.expr(WORDS), "__lines": F.expr(lines)})
    return cut_up.withColumns({n: F.expr(e) for n, e in MEASURES.items()}).withColumn("base_failed", F.expr(BASE_FAILED))


def sampled(docs: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` documents from all of the table, by a hash of their key: the same ones in every call."""
    share = max(docs.count() // max(rows, 1), 1)
    return docs.where(F.pmod(F.xxhash64(F.lit(7), F.col(f"`{key}`")), F.lit(share)) == 0)


def cascade_order(sample: DataFrame, rules: tuple[QualityRule, ...], text: str = "text") -> list[QualityRule]:
    """Rules by rejections per cost over the sample's documents that pass the base, most first; ties by name.

    A rule's cost is its work over these documents times its weight; `timed` gives rules with weights measured on the sample.
    """
    if not rules:
        return []
    # Written, as a condition on measures would else be moved before the words are split, and split them again for each.
    made = cut(measured(sample.select(F.col(f"`{text}`").alias("text"))).drop("text"))
    sums = [f"sum(CASE WHEN {r.fails} THEN 1 ELSE 0 END) AS r{i}" for i, r in enumerate(rules)]
    sums += [f"sum(cast({r.work} AS double)) AS w{i}" for i, r in enumerate(rules)]
    found = made.where("NOT base_failed").selectExpr(*sums).first()
    drop_cut(made)
    gain = {r.name: (found[f"r{i}"] or 0) / max((found[f"w{i}"] or 0.0) * r.weight, 1.0) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def timed(sample: DataFrame, rules: tuple[QualityRule, ...], text: str = "text", repeats: int = 3) -> tuple[QualityRule, ...]:
    """The rules with weights timed over the raw texts of a sample: what a job with the rule takes beyond one without."""
    raw = cut(measured(sample.select(F.col(f"`{text}`").alias("text"))).drop("text"))

    def seconds(condition: str) -> float:
        best = float("inf")
        for _ in range(repeats):
            began = time.perf_counter()
            raw.selectExpr("max(n_words)", f"count_if({condition})").write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    seconds("n_words < 0")  # the first job also compiles
    without = seconds("n_words < 0")
    work = raw.selectExpr(*[f"sum(cast({r.work} AS double)) AS w{i}" for i, r in enumerate(rules)]).first()
    found = tuple(replace(r, weight=max(1e9 * (seconds(r.fails) - without) / max(work[i] or 0.0, 1.0), 0.1)) for i, r in enumerate(rules))
    drop_cut(raw)
    return found


def verdict_sql(ordered: list[QualityRule]) -> str:
    """SQL for the first rule that a document fails; one is evaluated only where all before it passed."""
    return "CASE WHEN base_failed THEN 'base' " + " ".join(f"WHEN {r.fails} THEN '{r.name}'" for r in ordered) + " END"


def apply_quality_rules(
    docs: DataFrame, rules: tuple[QualityRule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", measure_costs: bool = False
) -> DataFrame:
    """Measure every whole text and judge it by the base rule and then by the cascade.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    failed_rule (the first rule of the cascade that failed, `base` for the base rule, else
    null); columns of these names are replaced, others may have any names. A document fails the
    base with under 50 words or over half of its words in repeated 3-word windows. A rule is
    evaluated only where all before it passed. Rules are ordered by rejections per cost, estimated on a
    sample by the hash of `key`: with `measure_costs` by the time that each takes there, else by its work
    there and the rules' own weights, so that the order is the same in every call. The order changes the
    cost and which of several failed rules is named, but no verdict. A null text is empty and fails the base; a null key is never or
    always in the sample. Repeated rows are judged alike; an empty table gives none. Very long texts are
    measured whole; each measure takes time in proportion to the text, but for sorts of its words.
    """
    sample = cut(sampled(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", sample_rows).select("text"))
    ordered = cascade_order(sample, timed(sample, rules, repeats=1) if measure_costs else rules)
    drop_cut(sample)
    source, names = plain_names(docs)
    made = measured(source, names[docs.columns.index(text)]).withColumn("failed_rule", F.expr(verdict_sql(ordered)))
    new = (*MEASURES, "base_failed", "failed_rule", "kept")
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new]
    return made.withColumn("kept", F.col("failed_rule").isNull()).select(*kept, *new)
