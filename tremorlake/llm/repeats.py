"""Removal of repeated passages: confirmed windows, sharded Aho-Corasick automata, streamed documents.

A window is a run of consecutive words. Two equal windows choose the same anchor, the least of
their grams, so only windows whose anchor occurs twice can recur. What is shuffled first is one
row for each anchor and not for each window; windows themselves are counted only where an
anchor stands in different surroundings. Documents are dealt into shards. The confirmed passages
of a shard, each taken once, from the first place where it stands, are compiled into an automaton;
all documents of the shard are streamed through it, and only its hits take words away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.runtime import cut, drop_cut, plain_names, shuffle_partitions
from tremorlake.llm.textkit import mix, packed, run_hash, text_slices, unpacked, words


@dataclass(frozen=True)
class Repeats:
    """Windows of `window` words; anchors are grams of `gram` words; documents meet in blocks of about `block_bytes`.

    A block that equal rows swell to over `heavy_blocks` times that is split.
    """

    window: int = 35
    gram: int = 10
    block_bytes: int = 1 << 20
    heavy_blocks: int = 32
    seed: int = 29


class Windows:
    """All windows of a slice of texts, in runs that share an anchor.

    Run r has the windows that start at words `low[r]` to `high[r]`; `anchor` and `around` are
    hashes of its gram and of all words that its windows touch with the gram's place in them.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spec: Repeats) -> None:
        self.spec = spec
        starts, ends, self.first = words(data, offsets)
        self.word = run_hash(spec.seed).of_bytes(data, starts, ends)
        at = np.arange(max(len(starts) - spec.window + 1, 0))
        owner = np.searchsorted(self.first, at, side="right") - 1
        at = at[at + spec.window <= self.first[owner + 1]]
        if not len(at):
            self.low = self.high = np.zeros(0, dtype=np.int64)
            self.anchor = self.around = np.zeros(0, dtype=np.uint64)
            return
        begin = np.arange(len(starts) - spec.gram + 1)
        grams = run_hash(spec.seed + 1).of_runs(self.word, begin, begin + spec.gram)
        choice = np.lib.stride_tricks.sliding_window_view(grams, spec.window - spec.gram + 1)
        place = at + choice[at].argmin(axis=1)
        edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.low, self.high = at[edge], at[np.append(edge[1:], len(at)) - 1]
        place = place[edge]
        self.anchor = grams[place]
        around = run_hash(spec.seed + 2).of_runs(self.word, self.low, self.high + spec.window)
        self.around = mix(around + (place - self.low).astype(np.uint64))

    def starts_of(self, runs: np.ndarray) -> np.ndarray:
        """The starts of all windows of some runs."""
        counts = self.high[runs] - self.low[runs] + 1
        return np.repeat(self.low[runs], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def prints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window that starts at `at`."""
        one, two = (run_hash(self.spec.seed + k).of_runs(self.word, at, at + self.spec.window) for k in (3, 4))
        return one.view(np.int64), two.view(np.int64)


def _anchors(docs: DataFrame, spec: Repeats) -> DataFrame:
    """(anchor, around, block) for each run of windows that share an anchor."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for row, _, data, offsets in text_slices(batch.column(1)):
                w = Windows(data, offsets, spec)
                owner = np.searchsorted(w.first, w.low, side="right") - 1
                columns = (w.anchor.view(np.int64), w.around.view(np.int64), blocks[row + owner])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "around", "block"])

    return docs.mapInArrow(made, "anchor long, around long, block long")


def _sorted(table: pa.Table, kind: int, *names: str) -> list[np.ndarray]:
    """Columns of the rows of a kind, sorted by the first."""
    columns = [table.column(n).to_numpy() for n in ("kind", *names)]
    keep = columns[0] == kind
    order = np.argsort(columns[1][keep], kind="stable")
    return [c[keep][order] for c in columns[1:]]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _among_pairs(one: np.ndarray, two: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    found = np.zeros(len(one), dtype=bool)
    at = np.searchsorted(known_one, one)
    while (live := np.flatnonzero((at < len(known_one)) & ~found)).size:
        live = live[known_one[at[live]] == one[live]]
        found[live] = known_two[at[live]] == two[live]
        if not (live := live[~found[live]]).size:
            break
        step = np.full(len(at), len(known_one))
        step[live] = at[live] + 1
        at = step
    return found


#: Facts about a block: anchors whose surroundings are all the same, other recurring anchors,
#: and recurring windows of the latter.
_SAME, _MIXED, _WINDOW = 0, 1, 2
_FACTS = "block long, kind int, h1 long, h2 long"


def _doubtful(blocks: DataFrame, facts: DataFrame, spec: Repeats) -> DataFrame:
    """(block, h1, h2, n): the windows of a block whose anchors stand in different surroundings."""

    def made(texts: pa.Table, known: pa.Table) -> pa.Table:
        mixed = _sorted(known, _MIXED, "h1")[0]
        parts = [np.zeros((0, 2), dtype=np.int64)]
        if len(mixed):
            for _, _, data, offsets in text_slices(unpacked(texts.column("text"))):
                w = Windows(data, offsets, spec)
                runs = np.flatnonzero(_among(w.anchor.view(np.int64), mixed))
                parts.append(np.stack(w.prints(w.starts_of(runs)), axis=1))
        prints = np.concatenate(parts)
        order = np.lexsort(prints.T[::-1])
        prints = prints[order]
        edge = np.flatnonzero(np.concatenate([[True], (prints[1:] != prints[:-1]).any(axis=1)])) if len(prints) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edge, len(prints)))
        block = (texts if texts.num_rows else known).column("block")[0].as_py()
        return pa.table({"block": np.full(len(edge), block), "h1": prints[edge, 0], "h2": prints[edge, 1], "n": counts})

    return blocks.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(made, "block long, h1 long, h2 long, n long")


def compiled(w: Windows, recurring: np.ndarray, texts: list[list[bytes]]) -> ahocorasick.Automaton:
    """The automaton of the confirmed passages of a slice; `recurring` has the starts of all windows that recur.

    Of stretches of recurring windows that are equal only the first one gives its passages: windows that
    tile it, each confirmed, which together cover the stretch.
    """
    size = w.spec.window
    edges = np.flatnonzero(np.concatenate([[True], np.diff(recurring) != 1, [True]]))
    # Stretches end where the text does, as no window reaches into the next text.
    low, high = recurring[edges[:-1]], recurring[edges[1:] - 1]
    prints = np.stack([run_hash(w.spec.seed + k).of_runs(w.word, low, high + size) for k in (5, 6)], axis=1)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for k in np.unique(prints, axis=0, return_index=True)[1]:
        owner = int(np.searchsorted(w.first, low[k], side="right")) - 1
        base = int(w.first[owner])
        for at in {*range(int(low[k]), int(high[k]), size), int(high[k])}:
            automaton.add_word(f" {b' '.join(texts[owner][at - base : at - base + size]).decode(errors='surrogateescape')} ")
    automaton.make_automaton()
    return automaton


def streamed(automaton: ahocorasick.Automaton, own: list[bytes], size: int) -> np.ndarray | None:
    """The words of a document that hits of the automaton cover; None for no hit."""
    if len(own) < size:
        return None
    body = f" {b' '.join(own).decode(errors='surrogateescape')} "
    ends = np.fromiter((end for end, _ in automaton.iter(body)), dtype=np.int64)
    if not len(ends):
        return None
    # The place of the space after each word, and from it the number of the word.
    spaces = np.flatnonzero(np.frombuffer(body.encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32) == 32)[1:]
    last = np.searchsorted(spaces, ends)
    steps = np.zeros(len(own) + 1, dtype=np.int64)
    np.add.at(steps, last - size + 1, 1)
    np.add.at(steps, last + 1, -1)
    return np.cumsum(steps)[:-1] > 0


def _packed(blocks: DataFrame, text: str) -> DataFrame:
    """The same rows with the texts compressed, as they go through a shuffle."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in blocks.schema.fields])
    at = blocks.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [packed(c) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return blocks.mapInArrow(made, schema)


def _cleaned(blocks: DataFrame, facts: DataFrame, spec: Repeats, names: list[str], at: int, schema: T.StructType) -> DataFrame:
    def made(texts: pa.Table, known: pa.Table) -> pa.Table:
        same, mixed = _sorted(known, _SAME, "h1")[0], _sorted(known, _MIXED, "h1")[0]
        one, two = _sorted(known, _WINDOW, "h1", "h2")
        n_words, n_removed, kept = [], [], []
        whole = unpacked(texts.column(names[at])) if texts.num_rows else pa.array([], pa.large_string())
        for _, _, data, offsets in text_slices(whole):
            body = data.tobytes()
            split = [body[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            covered: list[np.ndarray | None] = [None] * len(split)
            if len(same) or len(one):
                w = Windows(data, offsets, spec)
                anchors = w.anchor.view(np.int64)
                sure = w.starts_of(np.flatnonzero(_among(anchors, same)))
                maybe = w.starts_of(np.flatnonzero(_among(anchors, mixed)))
                maybe = maybe[_among_pairs(*w.prints(maybe), one, two)]
                recurring = np.sort(np.concatenate([sure, maybe]))
                if len(recurring):
                    automaton = compiled(w, recurring, split)
                    covered = [streamed(automaton, own, spec.window) for own in split]
            for own, cover in zip(split, covered, strict=True):
                n_words.append(len(own))
                n_removed.append(0 if cover is None else int(cover.sum()))
                kept.append(b" ".join(own if cover is None else compress(own, ~cover)))
        columns = [whole.cast(pa.string()) if n == names[at] else texts.column(n) for n in names]
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*columns, *new], [*names, "n_words", "n_removed", "kept_text"])

    return blocks.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(made, schema)


def remove_repeats(docs: DataFrame, text: str = "text", spec: Repeats = Repeats(), key: str = "doc_id") -> DataFrame:
    """Add n_words, n_removed and kept_text: each text without the words that a recurring window covers.

    A window recurs if its word sequence starts anywhere else, in the same text or another;
    all windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; kept
    words are joined by one space. Columns of the new names are replaced. A null text is
    empty; texts shorter than a window lose nothing. Repeated rows are copies of each other
    like any others, whatever their key, which may be null; they share blocks of bounded size.
    An empty table gives an empty result. Other columns may have any names. A very long text is taken
    whole, in a slice of its own; of equal passages none is kept before others: all of them go.
    """
    new = ("n_words", "n_removed", "kept_text")
    source, names = plain_names(docs)
    at = docs.columns.index(text)
    size = source.agg(F.sum(F.octet_length(names[at]))).first()[0] or 0
    count = max(-(-size // spec.block_bytes), 4 * shuffle_partitions(docs.sparkSession))
    block: Column = F.expr(f"pmod(xxhash64({names[docs.columns.index(key)]}, {names[at]}), {count}L)").alias("block")
    found = cut(_anchors(source.select(block, names[at]), spec).groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")))
    state = found.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("blocks")).where("n > 1")
    state = cut(state.select("anchor", "blocks", F.when(F.col("lo") == F.col("hi"), _SAME).otherwise(_MIXED).alias("kind")))
    # At most 4096 anchors can each lie in over a 4096th of all rows; they are broadcast, so that no task meets all rows of one.
    heavy = F.broadcast(state.where(F.col("blocks") > found.count() // 4096).select("anchor", F.col("kind").alias("heavy")))
    spread = found.join(heavy, "anchor", "left").withColumn("key", F.when(F.col("heavy").isNull(), F.col("anchor")).otherwise(F.col("block")))
    joined = spread.join(state.select(F.col("anchor").alias("key"), "kind"), "key", "left").withColumn("kind", F.coalesce("heavy", "kind"))
    anchors = cut(joined.where("kind IS NOT NULL").select("block", "kind", F.col("anchor").alias("h1"), F.lit(0).cast("long").alias("h2")))
    drop_cut(found, state)

    # Blocks that rows of equal key and text swell: at most size / (heavy_blocks * block_bytes) of them.
    swollen = source.groupBy(block).agg((F.sum(F.octet_length(names[at])) / (spec.heavy_blocks * spec.block_bytes)).cast("int").alias("more")).where("more > 0")
    swollen = F.broadcast(cut(swollen))

    def parts(rows: DataFrame, number: Column) -> DataFrame:
        """Rows with the number of a part of their block in the place of the block."""
        dealt = rows.join(swollen, "block", "left").withColumn("part", number)
        return dealt.withColumn("block", F.col("block") + count * F.col("part")).drop("more", "part")

    def texts(*columns: Column | str) -> DataFrame:
        return parts(source.select(block, *columns), F.when(F.col("more") > 0, F.pmod(F.monotonically_increasing_id(), F.col("more") + 1)).otherwise(F.lit(0)))

    def facts(rows: DataFrame) -> DataFrame:
        return parts(rows, F.explode(F.sequence(F.lit(0), F.coalesce("more", F.lit(0))))).select("block", "kind", "h1", "h2")

    doubtful = cut(_doubtful(_packed(texts(F.col(names[at]).alias("text")), "text"), facts(anchors.where(f"kind = {_MIXED}")), spec))
    twice = doubtful.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    windows = doubtful.select(F.pmod("block", F.lit(count)).alias("block"), "h1", "h2").join(twice, ["h1", "h2"]).distinct()
    windows = windows.select("block", F.lit(_WINDOW).alias("kind"), "h1", "h2")
    schema = T.StructType(
        [*source.schema.fields, *(T.StructField(n, k) for n, k in zip(new, (T.LongType(), T.LongType(), T.StringType()), strict=True))]
    )
    out = _cleaned(_packed(texts(*names), names[at]), facts(anchors.unionByName(windows)), spec, names, at, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new], *new)
