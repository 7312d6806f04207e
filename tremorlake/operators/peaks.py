"""Peaks of series of any length, with a least distance between them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.lineage import checkpointed, dropped
from tremorlake.operators.scans import BLOCK, BLOCK_ROWS, FRAME, KEY, PLACE, along, in_blocks, own_rows, plain, with_edges

#: What is known of a candidate.
OPEN, KEPT, GONE = 0, 1, 2


def local_maxima(series: DataFrame, keys: list[str], place: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, place, height) of the rows that are higher than the rows on both sides; of a plateau the middle, the left one of two.

    `series` has one row for each place 0, 1, ... of a series; the first and the last place are none. A null ends a plateau and is
    no neighbour that a peak is higher than. Runs of equal values are made one row each, whose neighbours are then the rows beside
    it, so that a plateau may be longer than a block.
    """
    blocks = in_blocks(series.select(*keys, F.col(place).alias("at"), F.col(value).alias("v")), keys, ["at"], block_rows)
    edged = with_edges(blocks, 1, 0, block_rows)
    starts = (F.col(PLACE) == 0) | ~F.col("v").eqNullSafe(F.lag("v").over(along()))
    runs = plain(own_rows(edged.withColumn("starts", starts)).where("starts")).drop("starts")
    numbered = in_blocks(runs, keys, ["at"], block_rows)
    around = with_edges(numbered, 1, 1, block_rows)
    beside = {"before": F.lag("v").over(along()), "after": F.lead("v").over(along()), "stop": F.lead("at").over(along())}
    found = own_rows(around.withColumns(beside)).where("v > before AND v > after")
    return found.select(*keys, F.floor((F.col("at") + F.col("stop") - 1) / 2).alias(place), F.col("v").alias("height"))


def _decided(distance: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Settles the candidates of a frame as far as what it sees allows, highest first, the later one on ties."""

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable").reset_index(drop=True)
        at, state = frame["at"].to_numpy(), frame["state"].to_numpy().copy()
        height, n = frame["height"].to_numpy(), len(frame)
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        for i in frame.sort_values(["height", "at"], ascending=False, kind="stable").index:
            if state[i] != OPEN:
                continue
            doubt = at[i] - distance < low or at[i] + distance >= high
            gone = False
            for step in (-1, 1):
                j = i + step
                while 0 <= j < n and abs(at[j] - at[i]) < distance:
                    if (height[j], at[j]) > (height[i], at[i]):
                        gone |= state[j] == KEPT
                        doubt |= state[j] == OPEN
                    j += step
            state[i] = GONE if gone else OPEN if doubt else KEPT
        return frame.assign(state=state)

    return decide


def find_peaks(series: DataFrame, keys: list[str], place: str, value: str, distance: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, place, height) of local maxima of which no two of a series are nearer than `distance` places.

    The highest one stays and all nearer ones than `distance` go, then the next highest that is left, and so on; of equal
    heights the later one is taken first. Places are cut in blocks, whose candidates see those some distances around them:
    what depends on candidates still further away stays open for the next round, with what is then known of those. Each
    round settles at least the highest open candidate of every series; a round is over when what it settled is written.
    """
    peaks = local_maxima(series, keys, place, value, block_rows)
    if distance <= 1:
        return peaks
    names = [f"__k{i}" for i in range(len(keys))]
    named = peaks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(place).cast("long").alias("at"), F.col("height").cast("double"))
    size, edge = max(block_rows, 8 * distance), 4 * distance
    block = F.floor(F.col("at") / size)
    state = checkpointed(named.withColumn("state", F.lit(OPEN)))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + f", {FRAME} bigint"
    decide = _decided(distance)
    while state.where(F.col("state") == OPEN).limit(1).count():
        framed = with_edges(state.withColumns({PLACE: F.col("at"), BLOCK: block}), edge, edge, size).drop(PLACE, BLOCK)
        # Before the first place there is nothing to see, so that nothing is missing there.
        low = F.when(F.col(FRAME) <= 0, F.lit(-(1 << 62))).otherwise(F.col(FRAME) * size - edge)
        framed = framed.withColumns({"low": low, "high": (F.col(FRAME) + 1) * size + edge})
        settled = framed.groupBy(*names, FRAME).applyInPandas(lambda frame: decide(frame).drop(columns=["low", "high"]), kind)
        new = checkpointed(settled.where(F.col(FRAME) == block).drop(FRAME))
        dropped(state)
        state = new
    return state.where(F.col("state") == KEPT).select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("at").alias(place), "height")
