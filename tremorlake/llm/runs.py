"""Periodic runs of words: maximal repetitions by the runs theorem.

Each run holds a Lyndon root that is the longest Lyndon word at its place under the order of the
words or under the reverse one. Those end at the next smaller and at the next greater value of the
inverse suffix array; each is extended to its run by longest common extensions, minima over ranges
of the LCP array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremorlake.llm.runtime import plain_names
from tremorlake.llm.textkit import text_slices, words

#: Steps by pointers before the rest of the next smaller values is looked for in a table of minima.
POINTER_STEPS = 8

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word data[start:end], the same for equal words."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])
    return held.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def prefix_ranks(symbols: np.ndarray, text: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, texts apart; the last one is the inverse suffix array.

    `text` is the number of each symbol's text and `end` the place where that text ends. A suffix that ends
    within the symbols compared comes before those that go on.
    """
    n = len(symbols)
    key = text * (int(symbols.max(initial=0)) + 1) + symbols
    rank, left, at = np.zeros(n, dtype=np.int32), np.arange(n), np.zeros(n, dtype=np.int64)
    levels, h = [], 0
    while len(left):
        order = np.argsort(key, kind="stable")
        left, key, base = left[order], key[order], at[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], base[1:] != base[:-1]])
        place = np.arange(len(left))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[left] = base + first - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        left = np.sort(left[~alone])
        h = max(1, 2 * h)
        at = rank[left].astype(np.int64)
        after = left + h
        second = np.where(after < end[left], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = at * (n + 1) + second
    return levels


class Minima:
    """Minima over ranges of an array, from a table of the minima of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of each values[low:high]; no range is empty."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for level in np.unique(k):
            which = np.flatnonzero(k == level)
            held = self.level(int(level))
            out[which] = np.minimum(held[low[which]], held[high[which] - (1 << int(level))])
        return out


def next_smaller(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first place after each one, before `end`, whose value is smaller; `end` where there is none."""
    n = len(values)
    to = np.minimum(np.arange(1, n + 1), end)
    left = np.arange(n)
    for _ in range(POINTER_STEPS):
        left = left[to[left] < end[left]]
        left = left[values[to[left]] > values[left]]
        if not len(left):
            return to
        to[left] = np.minimum(to[to[left]], end[left])
    minima = Minima(values)
    for k in range(max(int((end[left] - to[left]).max()), 1).bit_length(), -1, -1):
        held = minima.level(k)
        inside = to[left] + (1 << k) <= end[left]
        ahead = left[inside]
        far = ahead[held[to[ahead]] > values[ahead]] if len(held) else ahead[:0]
        to[far] += 1 << k
    return to


class Extensions:
    """Longest common extensions of two places of one text: minima over ranges of the LCP array."""

    def __init__(self, levels: list[np.ndarray], end: np.ndarray) -> None:
        self.rank, self.end = levels[-1], end
        order = np.empty(len(self.rank), dtype=np.int64)
        order[self.rank] = np.arange(len(self.rank))
        lcp = np.zeros(max(len(order) - 1, 0), dtype=np.int32)
        same = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
        a, b = order[:-1][same], order[1:][same]
        length = np.zeros(len(same), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + length, b + length
            inside = np.flatnonzero((x < end[a]) & (y < end[b]))
            equal = inside[levels[k][x[inside]] == levels[k][y[inside]]]
            length[equal] += 1 << k
        lcp[same] = length
        self.minima = Minima(lcp)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j, which differ, are equal; none from the end of the text on."""
        out = np.zeros(len(i), dtype=np.int64)
        inside = np.flatnonzero(j < self.end[i])
        a, b = self.rank[i[inside]].astype(np.int64), self.rank[j[inside]].astype(np.int64)
        out[inside] = self.minima.over(np.minimum(a, b), np.maximum(a, b))
        return out


def find_runs(symbols: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of `least` symbols at least, by start and period; starts count over all texts.

    Text k is symbols[bounds[k]:bounds[k + 1]]; no run goes over its ends.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(symbols):
        return none, none, none
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = bounds[text], bounds[text + 1]
    levels = prefix_ranks(symbols, text, end)
    rank = levels[-1]
    smaller, greater = next_smaller(rank, end), next_smaller(-rank, end)
    inner = np.flatnonzero(greater < end)
    i = np.concatenate([np.arange(len(symbols)), inner])
    period = np.concatenate([smaller - np.arange(len(symbols)), greater[inner] - inner])
    # What does not go on with the symbol a period before is no run.
    after = np.minimum(i + period, len(symbols) - 1)
    on = (i + period < end[i]) & (levels[0][after] == levels[0][i])
    i, period = i[on], period[on]
    if not len(i):
        return none, none, none
    extensions = Extensions(levels, end)
    stop = i + period + extensions.of(i, i + period)
    # The first root of a run, which is known by its end and period, starts within its first period.
    order = np.lexsort((i, period, stop))
    i, period, stop = i[order], period[order], stop[order]
    first = np.concatenate([[True], (stop[1:] != stop[:-1]) | (period[1:] != period[:-1])])
    i, period, stop = i[first], period[first], stop[first]
    may = stop - np.maximum(i - period + 1, begin[i]) >= np.maximum(least, 2 * period)
    i, period, stop = i[may], period[may], stop[may]
    low, high = np.maximum(i - period + 1, begin[i]), i.copy()
    while (open_ := low < high).any():
        k = np.flatnonzero(open_)
        middle = (low[k] + high[k]) // 2
        reaches = middle + period[k] + extensions.of(middle, middle + period[k]) >= stop[k]
        high[k] = np.where(reaches, middle, high[k])
        low[k] = np.where(reaches, low[k], middle + 1)
    length = stop - low
    kept = length >= np.maximum(least, 2 * period)
    low, length, period = low[kept], length[kept], period[kept]
    order = np.lexsort((period, low))
    return low[order], length[order], period[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of words joined by one space; text k has the words first[k] to first[k + 1]."""
    sizes = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(places[-1], 0x20, dtype=np.uint8)
    lengths = sizes - 1
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(places[:-1], lengths) + within] = data[np.repeat(starts, lengths) + within]
    # The space after the last word of each text goes.
    last = places[first[1:][first[1:] > first[:-1]]] - 1
    mask = np.ones(len(out), dtype=bool)
    mask[last] = False
    gone = np.concatenate([[0], np.cumsum(first[1:] > first[:-1])])
    offsets = places[first] - gone
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[mask])])


def find_periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """Find the runs of words of every whole text, and the text without their repeats.

    A run is a stretch of words whose smallest period is at most half of its length, that no neighbouring word
    extends, and that has `least` words at least. Adds n_words, runs (start as word number, length, period; by start,
    then period; several runs may start at one word) and collapsed_text: without each word that stands in any run after
    the first period of it, words joined by one space. Columns of these names are replaced, others may have any names.

    A null or empty text has no words and no runs. Repeated rows are treated alike; an empty table gives an empty
    result. Nothing is shuffled. A text is worked on whole within one task; texts share arrays of about 1 MB of text,
    and a longer one takes some n log n numbers of 4 bytes for its n words (a million words: about 200 MB).
    """
    source, names = plain_names(docs)
    at = names[docs.columns.index(text)]
    new = T.StructType().add("n_words", "long").add("runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed_text", "string")
    schema = T.StructType(source.schema.fields + new.fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(batch.schema.get_field_index(at))):
                starts, ends, bounds = words(data, offsets)
                start, length, period = find_runs(word_numbers(data, starts, ends), bounds, least)
                cover = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, start + length, -1)
                kept = np.cumsum(cover[:-1]) == 0
                before = np.concatenate([[0], np.cumsum(kept)])
                text_of = np.searchsorted(bounds, start, side="right") - 1
                places = np.searchsorted(start, bounds)
                struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bounds[text_of], length, period)], ["start", "length", "period"])
                made = [
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(places, pa.int32()), struct),
                    _joined(data, starts[kept], ends[kept], before[bounds]).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).columns, *made], [*batch.schema.names, *new.names])

    made = source.mapInArrow(find, schema)
    kept = [made[n].alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new.names]
    return made.select(*kept, *new.names)
