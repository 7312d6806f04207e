"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.runtime import cut, drop_cut, plain_names
from tremorlake.llm.textkit import lower_ascii, run_hash, text_slices

#: Bytes of benchmark texts that go to every executor at once.
BLOCK_BYTES = 4 << 20
#: Hits of texts, and starts of stretches to align, that are worked on at once; a single text with more hits is taken alone.
HITS_AT_ONCE = 1 << 18
STARTS_AT_ONCE = 1 << 12

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Matching:
    """An item leaks where any stretch of it of `short` or `piece` bytes (all of a shorter one) recurs within its edit budget.

    Stretches begin at every byte. The budget is `edits` for `piece` bytes and in proportion
    for fewer. Items under `shortest` bytes recur exactly, as whole words. Texts are compared with
    A-Z lower-cased and each run of ASCII characters other than letters and digits as one space.
    """

    q: int = 10
    piece: int = 96
    short: int = 50
    edits: int = 7
    shortest: int = 24

    def budget(self, length: int) -> int:
        return self.edits * length // self.piece


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as compared, their offsets by text, and the place of each in `data`."""
    data = lower_ascii(data)
    inside = _ALNUM[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    keep[edges] = inside[edges]
    places = np.flatnonzero(keep)
    out = data[places]
    out[~inside[places]] = 32
    return out, np.searchsorted(places, offsets), places


class PieceIndex:
    """The q-grams of a block of benchmark items, with their places."""

    def __init__(self, items: list[tuple[int, str | None]], matching: Matching) -> None:
        self.matching = matching
        #: Of each row of the index, in the order given, the item's id; rows with equal or null ids stay apart.
        self.ids = [item for item, _ in items]
        self.items: list[tuple[int, bytes]] = []
        self.exact: dict[int, list[tuple[int, bytes]]] = {}
        q = matching.q
        grams, owner, place = [], [], []
        for item, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            body = normalised(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")
            if len(body) < matching.shortest:
                if body:
                    self.exact.setdefault(len(body), []).append((item, body))
                continue
            data = np.frombuffer(body, dtype=np.uint8)
            begin = np.arange(len(data) - q + 1)
            grams.append(run_hash(23).of_bytes(data, begin, begin + q))
            owner.append(np.full(len(begin), len(self.items)))
            place.append(begin)
            self.items.append((item, body))
        hashes = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, starts = np.unique(hashes[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, dtype=np.int64)
        bits = max(16, int(np.ceil(np.log2(64 * len(self.hashes) + 1))))
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.may = np.zeros(int(self.mask) + 1, dtype=bool)
        self.may[self.hashes & self.mask] = True
        self.bytes = np.frombuffer(b"".join(b for _, b in self.items), dtype=np.uint8)
        self.length = np.array([len(b) for _, b in self.items], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length

    def _asked(self, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By item: length of a stretch, its budget, and the hits that the q-gram lemma asks of the diagonals of an occurrence."""
        length = np.minimum(self.length, piece)
        budget = self.matching.edits * length // self.matching.piece
        return length, budget, np.maximum(length + 1 - self.matching.q * (budget + 1), 1)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams of the index in texts, and which each is."""
        q = self.matching.q
        if len(data) < q or not len(self.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        begin = np.arange(len(data) - q + 1)
        found = run_hash(23).of_bytes(data, begin, begin + q)
        places = np.flatnonzero(self.may[found & self.mask])
        which = np.searchsorted(self.hashes, found[places])
        which[which == len(self.hashes)] = 0
        real = self.hashes[which] == found[places]
        return places[real], which[real]

    def occurrences(self, data: np.ndarray, edges: np.ndarray) -> list[dict[int | None, tuple[int, int, int]]]:
        """The same by the items' ids; of items with one id the place of least edits."""
        by_id: list[dict[int | None, tuple[int, int, int]]] = []
        for found in self.places(data, edges):
            by_id.append({})
            for row, match in found.items():
                by_id[-1][self.ids[row]] = min(by_id[-1].get(self.ids[row], match), match)
        return by_id

    def places(self, data: np.ndarray, edges: np.ndarray) -> list[dict[int, tuple[int, int, int]]]:
        """For each text the items that it holds, by their row in the index, with (edits, start, end) of one place in `data`."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(edges) - 1)]

        def note(text: int, item: int, match: tuple[int, int, int]) -> None:
            found[text][item] = min(found[text].get(item, match), match)

        for length, items in self.exact.items():
            self._whole(data, edges, length, items, note)
        places, which = self.hits(data)
        text = np.searchsorted(edges, places, side="right") - 1
        keep = places + self.matching.q <= edges[text + 1]
        places, which, text = places[keep], which[keep], text[keep]
        total = np.concatenate([[0], np.cumsum(self.starts[which + 1] - self.starts[which])])
        bounds = np.searchsorted(text, np.arange(len(edges)))
        i = 0
        while i < len(edges) - 1:
            most = total[bounds[i]] + HITS_AT_ONCE
            end = max(i + 1, int(np.searchsorted(total[bounds], most, side="right")) - 1)
            part = slice(bounds[i], bounds[end])
            if bounds[i] < bounds[end]:
                self._near(data, edges, places[part], which[part], text[part], note)
            i = end
        return found

    def _whole(self, data: np.ndarray, edges: np.ndarray, length: int, items: list[tuple[int, bytes]], note: Callable) -> None:
        """Notes the items of `length` bytes that texts hold exactly; an ASCII edge of an item is the edge of a word."""
        if len(data) < length:
            return
        begin = np.arange(len(data) - length + 1)
        found = run_hash(23).of_bytes(data, begin, begin + length)
        patterns = np.frombuffer(b"".join(b for _, b in items), dtype=np.uint8)
        at = np.arange(len(items)) * length
        for (item, body), value in zip(items, run_hash(23).of_bytes(patterns, at, at + length), strict=True):
            for start in np.flatnonzero(found == value).tolist():
                end, t = start + length, int(np.searchsorted(edges, start, side="right")) - 1
                inside = end <= edges[t + 1] and data[start:end].tobytes() == body
                left = start > edges[t] and body[0] < 128 and _ALNUM[data[start - 1]]
                right = end < edges[t + 1] and body[-1] < 128 and _ALNUM[data[end]]
                if inside and not left and not right:
                    note(t, item, (0, start, end))

    def _near(self, data: np.ndarray, edges: np.ndarray, places: np.ndarray, which: np.ndarray, text: np.ndarray, note: Callable) -> None:
        """Notes the items of which texts hold a stretch, from the texts' hits."""
        q = self.matching.q
        counts = self.starts[which + 1] - self.starts[which]
        at = np.repeat(self.starts[which], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row, place = self.owner[at], self.place[at]
        diagonal, text = np.repeat(places, counts) - place, np.repeat(text, counts)
        pair, hits = np.unique(text * len(self.items) + row, return_inverse=True, return_counts=True)[1:]
        length, _, least = self._asked(self.matching.short)
        keep = hits[pair] >= np.minimum(least, self._asked(self.matching.piece)[2])[row]
        row, place, diagonal, text, pair = (x[keep] for x in (row, place, diagonal, text, pair))
        # Whole stretches without edits: hits side by side on one diagonal.
        order = np.lexsort((place, diagonal, pair))
        run = length[row[order]] - q
        a = np.flatnonzero(np.arange(len(order)) + run < len(order))
        a, b = order[a], order[a + run[a]]
        same = (pair[a] == pair[b]) & (diagonal[a] == diagonal[b]) & (place[b] - place[a] == length[row[a]] - q)
        done = np.zeros(len(hits), dtype=bool)
        for k in a[same]:
            if done[pair[k]]:
                continue
            start, size = int(diagonal[k] + place[k]), int(length[row[k]])
            item, body = self.items[row[k]]
            if data[start : start + size].tobytes() == body[place[k] : place[k] + size]:
                done[pair[k]] = True
                note(int(text[k]), item, (0, start, start + size))
        for piece in (self.matching.short, self.matching.piece):
            keep = ~done[pair]
            if piece == self.matching.piece:  # a shorter item has had its turn
                keep &= self.length[row] > self.matching.short
            rest = tuple(x[keep] for x in (row, place, diagonal, text, pair))
            if len(rest[0]):
                self._edited(data, edges, *rest, piece, done, note)

    def _edited(
        self, data: np.ndarray, edges: np.ndarray, row: np.ndarray, place: np.ndarray, diagonal: np.ndarray, text: np.ndarray, pair: np.ndarray,
        piece: int, done: np.ndarray, note: Callable,
    ) -> None:
        """Notes the stretches of `piece` bytes within their budgets: enough hits in a band, then alignment."""
        length, budget, least = self._asked(piece)
        band = diagonal // (budget[row] + 1)
        row, place, text, pair = (np.concatenate([x, x]) for x in (row, place, text, pair))
        band = np.concatenate([band, band - 1])
        order = np.lexsort((place, band, pair))
        row, place, text, pair, band = (x[order] for x in (row, place, text, pair, band))
        a = np.flatnonzero(np.arange(len(row)) + least[row] - 1 < len(row))
        b = a + least[row[a]] - 1
        near = (pair[a] == pair[b]) & (band[a] == band[b]) & (place[b] - place[a] <= length[row[a]] - self.matching.q)
        a, b = a[near], b[near]
        low = np.maximum(place[b] - (length[row[a]] - self.matching.q), 0)
        # Starts in order within a band: those that the hit before has given are left out.
        high = np.minimum(place[a], self.length[row[a]] - length[row[a]])
        again = (pair[a[1:]] == pair[a[:-1]]) & (band[a[1:]] == band[a[:-1]])
        low[1:] = np.where(again, np.maximum(low[1:], high[:-1] + 1), low[1:])
        ends = np.cumsum(np.maximum(high - low + 1, 0))
        for begin in range(0, int(ends[-1]) if len(ends) else 0, STARTS_AT_ONCE):
            n = np.arange(begin, min(begin + STARTS_AT_ONCE, int(ends[-1])))
            k = np.searchsorted(ends, n, side="right")
            start = high[k] - (ends[k] - 1 - n)
            h = a[k]
            for size in np.unique(length[row[h]]):
                own = np.flatnonzero(length[row[h]] == size)
                r, g = row[h[own]], int(budget[row[h[own[0]]]])
                patterns = self.bytes[(self.first[r] + start[own])[:, None] + np.arange(size)]
                t = text[h[own]]
                edits, s, e = banded_alignments(patterns, data, band[h[own]] * (g + 1) + start[own], 2 * (g + 1), g, edges[t], edges[t + 1])
                for i in np.flatnonzero(edits <= g):
                    done[pair[h[own[i]]]] = True
                    note(int(t[i]), self.items[r[i]][0], (int(edits[i]), int(s[i]), int(e[i])))


def banded_alignments(
    patterns: np.ndarray, data: np.ndarray, low: np.ndarray, starts: int, budget: int, begin: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of each pattern in its text data[begin:end], started at one of `starts` places from `low` on.

    Only alignments with at most `budget` edits count, so only diagonals that near are filled;
    more edits than that stand for none.
    """
    d = np.arange(starts + 2 * budget)
    # cost[d]: least edits of the prefix of the pattern that ends on diagonal d, times 256, and its start.
    at = (low - budget)[:, None] + d
    far = (budget + 1) << 8
    able = (d >= budget) & (d < budget + starts) & (at >= begin[:, None]) & (at <= end[:, None])
    cost = np.where(able, d, far)
    for symbol in patterns.T:
        inside = (at >= begin[:, None]) & (at < end[:, None])
        differ = data[np.clip(at, 0, len(data) - 1)] != symbol[:, None]
        new = np.where(inside, cost + (differ << 8), far)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 256)
        new = np.minimum.accumulate(new - (d << 8), axis=1) + (d << 8)
        cost = np.minimum(np.where(at < end[:, None], new, far), far)
        at = at + 1
    last = cost.argmin(axis=1)
    best = cost[np.arange(len(cost)), last]
    return best >> 8, low - budget + (best & 255), low - budget + last + patterns.shape[1]


def _found(column: pa.Array, index: PieceIndex) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each text its (item, start, end, edits), places in code points of the text itself."""
    for _, _, data, offsets in text_slices(column):
        body, edges, origin = normalised(data, offsets)
        for i, matches in enumerate(index.places(body, edges)):
            rows = []
            for item, (edits, start, end) in matches.items():
                begin, stop = origin[start], origin[max(end - 1, start)] + 1
                before = len(data[offsets[i] : begin].tobytes().decode(errors="replace"))
                rows.append((index.ids[item], before, before + len(data[begin:stop].tobytes().decode(errors="replace")), edits))
            yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def _blocks(benchmark: DataFrame, matching: Matching, block_bytes: int) -> Iterator[tuple[PieceIndex, bool]]:
    """Indexes of the benchmark by blocks of about `block_bytes` of text, so that each may be broadcast, and whether there are several.

    The driver holds one block at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for k in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}L) = {k}")).collect()
        yield PieceIndex(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), matching), blocks > 1


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", matching: Matching = Matching(), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each benchmark item that each document holds, with one place of it.

    Every whole text is compared with every item. Texts and items that are null or hold no
    letter or digit match nothing. Rows that repeat a doc_id or an item_id give their own matches;
    null ids are carried. A benchmark beyond `block_bytes` takes one pass over the documents for each
    block, whose results are written before the next index is broadcast. Further columns of both tables, whatever their names, play no part. An empty table on either side gives an empty
    result. A very long text is searched whole by one task; of several places of an item the one of fewest edits is told,
    then the first.
    """
    kinds = (("doc_id", T.LongType()), ("item_id", T.LongType()), ("start", T.LongType()), ("end", T.LongType()), ("edits", T.LongType()))
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])
    source = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`"))
    parts = []
    for index, several in _blocks(benchmark, matching, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(doc, *r) for doc, found in zip(ids, _found(batch.column(1), shared.value), strict=True) for r in found]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [n for n, _ in kinds])

        part = source.mapInArrow(matched, schema)
        parts.append(cut(part) if several else part)
        if several:
            shared.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", matching: Matching = Matching(), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with the same columns; nothing is shuffled.

    As in `find_leaks`, a benchmark beyond `block_bytes` takes one pass over the documents for each block, with one
    index broadcast at a time. Rows without an id or a text stay, repeated rows are judged alike.
    """
    out, names = plain_names(docs)
    at = docs.columns.index(text)
    for index, several in _blocks(benchmark, matching, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _found(batch.column(at), shared.value)], pa.bool_()))

        made = out.mapInArrow(clean, out.schema)
        if several:
            before, out = out, cut(made)
            shared.destroy()
            if hasattr(before, "cut_folder"):
                drop_cut(before)
        else:
            out = made
    return out.toDF(*docs.columns)
