"""Best-fit packing of token pieces into sequences, certified by lower bounds, with repacking."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.runtime import cut, plain_names
from tremorlake.llm.tokens import TokenIds

#: Pieces of a partition that is packed at once.
PIECES_PER_GROUP = 2048

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, text: str = "text") -> DataFrame:
    """The pieces of every document: its token ids and `end_id`, cut only where longer than `size`.

    Cuts are made from the end, so that all pieces but the first have `size` tokens. Returns
    doc_id, piece, start, length and the CRC-32 of the piece's ids as little-endian unsigned
    32-bit numbers. A null text is empty: one piece with the end id. A null doc_id stays
    null. Repeated rows give their pieces again.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenIds(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode(text_.as_py() or "") + end
                n = len(data) // 4
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`")).mapInArrow(cut_up, PIECE)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still holds it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    room: list[tuple[int, int]] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = bisect_left(room, (need, -1))
        if at == len(room):
            left, number = size, made
            made += 1
        else:
            left, number = room.pop(at)
        bins[i] = number
        if left > need:
            insort(room, (left - need, number))
    return bins


def bin_lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing of counts[n] items of each length n has fewer bins: the best of three families of dual-feasible functions.

    Each maps lengths so that what fits into one bin still sums to at most one bin: the length
    itself; for each e up to half a bin, dropping items under e and rounding those over
    size - e up to a whole bin; for each k, rounding (k + 1) / k of the length down to k-ths.
    """
    if not counts.any():
        return 0
    sizes = np.arange(size + 1)
    total = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    e = np.arange(0, size // 2 + 1)
    middle = total[size - e + 1] - total[e]
    best = int(np.max(-(-(middle + (number[size + 1] - number[size - e + 1]) * size) // size)))
    for k in range(1, 64):
        grown = sizes * (k + 1)
        units = np.where(grown % size == 0, grown * k // (k + 1), grown // size * size)
        best = max(best, int(-(-(counts @ units) // (size * k))))
    return best


def _packed(group: pd.DataFrame, size: int) -> pd.DataFrame:
    """Bins of one group; final: whether they stay, as certified or full."""
    group = group.sort_values(["length", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
    lengths = group["length"].to_numpy()
    bins = best_fit_decreasing(lengths, size)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    stays = fill == size
    if len(fill) == bin_lower_bound(np.bincount(lengths, minlength=size + 1), size):
        # The optimum of the group; only its emptiest bin can still be filled by another group.
        stays = np.ones(len(fill), dtype=bool)
        stays[np.argmin(fill)] = fill.min() == size
    order = group.groupby(bins)["length"].cumsum() - group["length"]
    return group.assign(bin=bins, final=stays[bins], offset=order.astype("int64"))


def _packer(size: int, turn: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs a group; its bins' numbers hold the group and the round, so that no two are the same."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        made = _packed(group.drop(columns="group"), size)
        return made.assign(bin=(int(key[0]) << 32 | turn << 24) + made["bin"])

    return pack


def pack_best_fit(pieces: DataFrame, size: int, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Add sequence_id and offset: pieces share sequences of at most `size` tokens.

    Groups of about `per_group` pieces are packed by best-fit decreasing. A group whose bins
    are as few as its lower bound is certified and keeps them, but for the emptiest; in
    others only full bins stay. What is left is exchanged: dealt anew over fewer groups and packed again, as long as
    that takes fewer sequences than before and there is more than one group. What is then not certified stays in
    the fewest sequences found, and `packing_gap` tells how far from the bound all are. Pieces must have
    1 to `size` tokens in the column length; other columns may have any names, and those of the
    new names are replaced. Repeated rows are pieces of their own. An empty table gives an
    empty result.
    """
    source, names = plain_names(pieces)
    length = names[pieces.columns.index("length")]
    left = cut(source.select(F.monotonically_increasing_id().alias("key"), F.col(length).alias("length"), F.struct(*names).alias("row")))
    schema = f"key long, length long, row {left.schema['row'].dataType.simpleString()}, bin long, final boolean, offset long"
    done: list[DataFrame] = []
    n, turn, last, least = left.count(), 0, None, 0
    while True:
        groups = -(-max(n, 1) // per_group)
        dealt = left.withColumn("group", F.expr(f"pmod(xxhash64(key, {turn}L), {groups}L)"))
        packed = cut(dealt.groupBy("group").applyInPandas(_packer(size, turn), schema))
        if last is not None and packed.select("bin").distinct().count() >= least:
            done.append(last)
            break
        last = packed.where("NOT final")
        n, least = last.agg(F.count("*"), F.count_distinct("bin")).first()
        if not n or groups == 1:
            done.append(packed)
            break
        done.append(packed.where("final"))
        left, turn = last.drop("bin", "final", "offset"), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    new = ("sequence_id", "offset")
    kept = [F.col(f"row.{n}").alias(c) for n, c in zip(names, pieces.columns, strict=True) if c not in new]
    return out.select(*kept, F.col("bin").alias("sequence_id"), "offset")


def packing_gap(packed: DataFrame, size: int) -> tuple[int, int]:
    """How many sequences there are, and the bound that no packing of the same pieces can be under."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in packed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return packed.select("sequence_id").distinct().count(), bin_lower_bound(counts, size)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """Tokenize whole documents, cut those over `size` tokens, and pack the pieces.

    A null or empty text is a piece of the end id alone; null ids are carried; repeated rows give their pieces each; an
    empty table gives an empty result. A very long text is encoded by one task and cut into as many pieces as it needs.
    Pieces of equal length are packed in the order of their rows' numbers. Other columns of `docs` play no part.
    """
    return pack_best_fit(token_pieces(docs, path, size, end_id, text), size)
