"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier decides.

Everything that touches documents is built-in functions. The driver sees only how often each
pattern of votes and features occurs, at most one row for each of the 4 * 3**6 * 32 possible ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.runtime import plain_names

KINDS = ("email", "ip", "card", "phone")

#: Base matches as Java regular expressions. Possessive runs and the conditions before the
#: first character only spare attempts that cannot match: they leave the matches as they are.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser shapes that only the vote can accept: addresses written out or with brackets around
#: dots, cards in groups between other signs, numbers without a plus or with two zeros for it.
#: A group that repeats without bound is possessive: Java matches a greedy one by recursion, as deep as the text is long.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,64})++",
    "ip": r"(?<![0-9.\]])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?\[dot\]\x20?)[0-9]{1,3}){3}(?![0-9\[])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9._/])",
    "phone": r"(?<![0-9+(.-])(?<![0-9]\x20)(?:00[1-9][0-9]{0,2}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,4}|(?:\([0-9]{3}\)\x20|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9.-])",
}

#: A cheap test that a text can hold a match at all.
_HINT = {"email": "contains({t}, '@')", "phone": "contains({t}, '+')"}
_LOOSE_HINT = {"email": "{t} RLIKE '[\\\\[(]at[\\\\])]'", "ip": "{t} RLIKE '[0-9](\\\\[\\\\.|\\\\(\\\\.|\\\\x20?\\\\[dot)'"}

#: Items of an array that a fold takes at once: its results are copied at each step of their block only.
FOLD = 128

_SPAN = "struct<start:int,end:int,first:int,last:int,match:string,before:string>"

_DIGITS = "regexp_replace(x.match, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(sequence(1, length({_DIGITS})),
    i -> CASE WHEN i % 2 = 1 THEN int(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1))
              WHEN substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) >= '5'
              THEN 2 * int(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1)) - 9
              ELSE 2 * int(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1)) END), 0, (a, b) -> a + b) % 10 = 0"""

#: What a base match must also meet.
VALID = {
    "email": "true",
    "ip": r"forall(split(x.match, '\\.'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND int(concat('0', right(regexp_replace(p, '^0+', ''), 3))) <= 255)",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}

#: Gazetteers: endings of addresses, prefixes of card issuers by length, calling codes; words that
#: announce a kind and words that speak against it.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|eu|de|fr|es|it|nl|pt|pl|se|ch|at|be|uk|us|ca|mx|ar|cl|br|jp|cn|in|au|nz|ru"
ISSUERS = "4([0-9]{12}|[0-9]{15}|[0-9]{18})|(5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6(011|5[0-9]{2})[0-9]{12}"
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ANNOUNCE = {
    "email": r"(?i)\\b(e-?mails?|mail|mailto|contact|contacto|kontakt|write|reply|correo|courriel|adresse|address)\\b",
    "ip": r"(?i)\\b(ip|ipv4|host|server|serveur|servidor|address|addr|login|from|client|peer|gateway|dns)\\b",
    "card": r"(?i)\\b(card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|carte|tarjeta|paid|charge)\\b",
    "phone": r"(?i)\\b(call|phone|tel|telephone|fax|mobile|cell|whatsapp|telefon|telefono|handy|ring)\\b",
}
AGAINST = r"(?i)(\\b(version|release|token|isbn|issn|doi|order|invoice|serial|section|chapter|page|figure|table|build)\\b|[=#/_]\\s*$)"
LABELERS = ("regex", "structure", "gazetteer", "context", "against", "variety")

#: A candidate that is no base match is added from this probability on.
THRESHOLD = 0.5


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(items: str, carry: str, out: str, kind: str, step: str) -> str:
    """SQL for `out` of each item x, an array of `kind`, after what `step` makes of c, at first `carry`, of those before it.

    The fold goes block by block, so that its time grows with the number of items, not with its square.
    """
    inner = f"""aggregate(bl, named_struct('c', a.c, 'o', cast(array() AS array<{kind}>)),
        (b, x) -> element_at(transform(array(b.c), c -> named_struct('c', {step}, 'o', concat(b.o, array({out})))), 1))"""
    return f"""element_at(transform(array({items}), v -> aggregate(
        transform(sequence(0, greatest(size(v) - 1, 0) div {FOLD}), k -> slice(v, int(k * {FOLD} + 1), {FOLD})),
        named_struct('c', {carry}, 'o', cast(array() AS array<array<{kind}>>)),
        (a, bl) -> element_at(transform(array({inner}), r -> named_struct('c', r.c, 'o', concat(a.o, array(r.o)))), 1),
        a -> flatten(a.o))), 1)"""


def _matches(pattern: str, kind: str, strict: bool) -> str:
    """SQL for the leftmost, non-overlapping matches of `pattern` in __text.

    Each with its places in code points (start, end) and bytes (first, last), and with the 40 characters before it.
    """
    p = _quoted(pattern)
    hint = _HINT.get(kind, "true").format(t="__text") if strict else _LOOSE_HINT.get(kind, "true").format(t="__text")
    items = """transform(r.m, (x, i) -> named_struct('gap', length(get(r.s, i)), 'gapb', octet_length(get(r.s, i)), 'len', length(x), 'lenb', octet_length(x),
        'match', x, 'before', right(concat(coalesce(get(r.m, i - 1), ''), get(r.s, i)), 40)))"""
    out = """named_struct('start', c.p + x.gap, 'end', c.p + x.gap + x.len, 'first', c.q + x.gapb, 'last', c.q + x.gapb + x.lenb, 'match', x.match, 'before', x.before)"""
    step = "named_struct('p', c.p + x.gap + x.len, 'q', c.q + x.gapb + x.lenb)"
    return f"""CASE WHEN {hint} AND __text RLIKE {p} THEN element_at(transform(
        array(named_struct('m', regexp_extract_all(__text, {p}, 0), 's', split(__text, {p}, -1))),
        r -> {_scan(items, "named_struct('p', 0, 'q', 0)", out, _SPAN, step)}), 1) ELSE cast(array() AS array<{_SPAN}>) END"""


def _votes(kind: str, strict: bool) -> str:
    """SQL for the candidates of a kind with their votes (1 for, -1 against, 0 none) and features.

    The regex labeler only knows the shape, the structure labeler only what a value of the kind must meet, the others
    look at lists of endings, issuers and codes, at words before the match, and at how varied its digits are.
    """
    structure = {
        "email": "right(x.match, 2) RLIKE '^[A-Za-z]{2}$' AND NOT x.match RLIKE '\\\\.\\\\.'",
        "ip": VALID["ip"].replace("split(x.match, '\\\\.')", "split(x.match, '[^0-9]+')"),
        "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
        "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    }[kind]
    gazetteer = {
        "email": rf"CASE WHEN x.match RLIKE '(?i)(\\.|dot[\\])]\\x20?)({ENDINGS})$' THEN 1 ELSE -1 END",
        "ip": r"CASE WHEN x.match RLIKE '^(0|22[4-9]|2[3-5][0-9])[^0-9]' THEN -1 WHEN x.match RLIKE '^(10|127|172|192)[^0-9]' THEN 1 ELSE 0 END",
        "card": f"CASE WHEN {_DIGITS} RLIKE '^({ISSUERS})$' THEN 1 ELSE -1 END",
        "phone": f"CASE WHEN {_DIGITS} RLIKE '^0*({CODES})' AND x.match RLIKE '^(\\\\+|00)' THEN 1 WHEN {_DIGITS} RLIKE '^0{{4}}' THEN -1 ELSE 0 END",
    }[kind]
    varied = "0" if kind == "email" else f"CASE WHEN size(array_distinct(split({_DIGITS}, ''))) <= 3 THEN -1 ELSE 1 END"
    k = KINDS.index(kind)
    return f"""transform({_matches(BASE[kind] if strict else LOOSE[kind], kind, strict)}, x -> named_struct(
        'start', x.start, 'kind', {k}, 'end', x.end, 'first', x.first, 'last', x.last,
        'base', {"(" + VALID[kind] + ")" if strict else "false"},
        'votes', concat({k}, ':', array_join(array(
            {1 if strict else 0},
            CASE WHEN {structure} THEN 1 ELSE -1 END,
            {gazetteer},
            CASE WHEN x.before RLIKE '{ANNOUNCE[kind]}' THEN 1 ELSE 0 END,
            CASE WHEN x.before RLIKE '{AGAINST}' THEN -1 ELSE 0 END,
            {varied}), ','), '|', array_join(array(
            least(length(x.match) div 8, 3), length({_DIGITS}) * 3 div length(x.match), int(x.before RLIKE '[A-Za-z0-9]$')), ','))))"""


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add __text and __found, an array of (start, kind, end, first, last, base, votes) sorted by start and kind."""
    found = [_votes(k, True) for k in KINDS] + [_votes(k, False) for k in LOOSE]
    return docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(
        "__found", F.expr(f"sort_array(concat({', '.join(found)}))")
    )


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers from EM and the probability of each pattern of votes."""

    reliability: dict[str, float]
    probability: dict[str, float]

    def accepted(self, threshold: float = THRESHOLD) -> list[str]:
        """Patterns of loose shape that reach the threshold; what has the base's shape but fails its conditions stays out."""
        return sorted(p for p, v in self.probability.items() if v >= threshold and not _parsed(p)[1][0])


def _parsed(pattern: str) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    kind, rest = pattern.split(":")
    votes, features = rest.split("|")
    return int(kind), tuple(map(int, votes.split(","))), tuple(map(int, features.split(",")))


def fit_span_model(counts: dict[str, int], rounds: int = 50, steps: int = 200) -> SpanModel:
    """EM over the counts of vote patterns, then a logistic classifier on the posteriors.

    The labelers are taken as independent given the truth; each has a smoothed distribution
    over its three votes for true and for false spans of each kind, its reliability, by which
    EM weighs it. EM starts from the sign of the sum of votes. The classifier learns the
    posteriors from the votes, the kind and what no labeler sees: the length of the match, its
    share of digits, and whether it follows a letter or digit.
    """
    rows = [(p, *_parsed(p), n) for p, n in sorted(counts.items())]
    held: dict[tuple, int] = {}
    for _, k, v, _, n in rows:
        held[k, v] = held.get((k, v), 0) + n
    belief = {kv: 0.9 if sum(kv[1]) > 0 else 0.1 for kv in held}
    share: dict[bool, list[dict[int, float]]] = {}
    for _ in range(rounds):
        share = {}
        for y in (True, False):
            share[y] = []
            for j in range(len(LABELERS)):
                # A labeler is taken as better than chance until the votes say otherwise.
                mass = {1: 2.0 if y else 1.0, 0: 1.0, -1: 1.0 if y else 2.0}
                for (k, v), n in held.items():
                    mass[v[j]] += n * (belief[k, v] if y else 1 - belief[k, v])
                total = sum(mass.values())
                share[y].append({vote: m / total for vote, m in mass.items()})
        prior = {k: [1.0, 1.0] for k in range(len(KINDS))}
        for (k, v), n in held.items():
            prior[k][0] += n * belief[k, v]
            prior[k][1] += n * (1 - belief[k, v])
        for k, v in held:
            odds = math.log(prior[k][0] / prior[k][1])
            odds += sum(math.log(share[True][j][v[j]] / share[False][j][v[j]]) for j in range(len(LABELERS)))
            belief[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    truth = {p: belief[k, v] for p, k, v, _, _ in rows}
    features = {
        p: [*map(float, v), *(float(k == i) for i in range(len(KINDS))), *(float(f[0] == i) for i in range(4)), *(float(f[1] == i) for i in range(4)), float(f[2])]
        for p, k, v, f, _ in rows
    }
    weights = [0.0] * (len(LABELERS) + len(KINDS) + 9)
    # Patterns count by the root of their number, so that rare ones have a say.
    mass = {p: math.sqrt(n) for p, *_, n in rows}
    total = sum(mass.values()) or 1.0

    def chance(p: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * x for w, x in zip(weights, features[p], strict=True))))))

    for _ in range(steps):
        gradient = [0.0005 * w for w in weights]
        for p, *_ in rows:
            error = (chance(p) - truth[p]) * mass[p] / total
            gradient = [g + error * x for g, x in zip(gradient, features[p], strict=True)]
        weights = [w - 2 * g for w, g in zip(weights, gradient, strict=True)]
    reliability = {
        name: share[True][j][1] / (share[True][j][1] + share[False][j][1]) if share else 0.5
        for j, name in enumerate(LABELERS)
    }
    return SpanModel(reliability, {p: chance(p) for p, *_ in rows})


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.kind), ':', x.start, ':', x.end)), ',')")


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Find e-mail addresses, IP addresses, card and phone numbers in every whole text.

    Adds n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all, as text) and
    found (all, as array of start, kind, end in code points and first, last in bytes, ends
    exclusive); columns of these names are replaced, others may have any names. Base matches
    always stay; candidates of looser shape that overlap none are added where the classifier
    gives them `threshold` at least. A null text is empty: no spans. Repeated rows are treated
    alike; an empty table gives an empty result. Very long texts are searched whole, in time linear
    in their length for every shape; of spans that start at one place the kind listed first comes first.
    """
    source, names = plain_names(docs)
    found = candidates(source, names[docs.columns.index(text)])
    patterns = found.select(F.explode("__found").alias("x")).groupBy("x.votes").count()
    model = fit_span_model({r["votes"]: r["count"] for r in patterns.collect()})
    accepted = ", ".join(f"'{p}'" for p in model.accepted(threshold)) or "''"
    loose = f"""filter(__found, x -> NOT x.base AND x.votes IN ({accepted})
        AND NOT exists(__base, b -> b.start < x.end AND x.start < b.end))"""
    made = found.withColumn("__base", F.expr("filter(__found, x -> x.base)"))
    made = made.withColumn(
        "found",
        F.expr(f"""sort_array(transform(concat(__base, {loose}),
            x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end, 'first', x.first, 'last', x.last)))"""),
    )
    counted = {
        f"n_{k}": F.expr(f"cast(size(filter(__base, x -> x.kind = {i})) AS bigint)") for i, k in enumerate(KINDS)
    }
    made = made.withColumns(
        {**counted, "base_sha256": F.sha2(_joined("__base"), 256), "spans": _joined("found")}
    )
    new = (*counted, "base_sha256", "spans", "found")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new], *new)


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns, with every span replaced by its kind, as `<EMAIL>`; a null text stays null.

    Of spans that overlap the first gives the name, and all that they cover goes.
    """
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    source, plain = plain_names(docs)
    t = plain[docs.columns.index(text)]
    found = find_personal_data(source, t, threshold)
    # Bytes are cut at their places, without a walk from the start of the text for each span.
    pieces = _scan("found", "0", f"CASE WHEN x.first < c THEN X'' ELSE concat(substring(cast({t} AS binary), c + 1, x.first - c), cast(get({names}, x.kind) AS binary)) END", "binary", "greatest(c, x.last)")
    rest = f"substring(cast({t} AS binary), aggregate(found, 0, (m, x) -> greatest(m, x.last)) + 1)"
    joined = f"cast(unhex(concat(array_join(transform({pieces}, b -> hex(b)), ''), hex({rest}))) AS string)"
    made = found.withColumn("__clean", F.expr(f"CASE WHEN size(found) = 0 THEN {t} ELSE {joined} END"))
    return made.select(*[F.col("__clean" if n == t else n).alias(c) for n, c in zip(plain, docs.columns, strict=True)])
