"""Ordered work on series of any length: rows are numbered within their series and dealt in blocks of equal size.

A running sum, a last known value or a whole of a series is carried from block to block by one small row
for each block; a moving frame takes the rows next to its block along. No task holds more than a block and
its edges, however long a series is or how many rows one key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tremorlake.functions.lineage import checkpointed, dropped

#: Rows of a block.
BLOCK_ROWS = 1 << 16

#: A series and the block of a row in it; a frame with the rows next to the block.
KEY, BLOCK, PLACE, FRAME = "__key", "__block", "__i", "__frame"


def in_blocks(rows: DataFrame, keys: list[str], order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds __key (a struct of the keys, which may be null), __i (place in the series from 0, by `order`) and __block.

    Rows are dealt by ranges of keys and order, so that a long series lies in many tasks; a range can go on with the last
    series of the one before it and with no other, so that the counts which are carried are one row for each range. The
    ranges and the result are written once: all that reads them sees the same numbers. Rows of equal order lie in one range,
    in any order among them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    dealt = checkpointed(keyed.repartitionByRange(parts, KEY, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(KEY, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(KEY).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(KEY, "__part", F.sum("__n").over(earlier).alias("__before")).where("__before > 0")
    within = F.row_number().over(Window.partitionBy(KEY, "__part").orderBy(*order)) - 1
    numbered = dealt.withColumn(PLACE, within).join(F.broadcast(before), [KEY, "__part"], "left")
    numbered = numbered.withColumn(PLACE, F.col(PLACE) + F.coalesce("__before", F.lit(0)))
    made = checkpointed(numbered.withColumn(BLOCK, F.floor(F.col(PLACE) / block_rows)).drop("__part", "__before"))
    dropped(dealt)
    return made


def plain(blocks: DataFrame) -> DataFrame:
    """Without the columns that tell the blocks."""
    return blocks.drop(KEY, BLOCK, PLACE, FRAME)


def inside() -> WindowSpec:
    """The rows of a block up to the current one."""
    return Window.partitionBy(KEY, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)


def carried(blocks: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Adds the columns of `carry`, window expressions over the blocks of a series (`by_block`) of what `summary` makes of each block."""
    sums = blocks.groupBy(KEY, BLOCK).agg(*[c.alias(n) for n, c in summary.items()])
    return blocks.join(sums.select(KEY, BLOCK, *[c.alias(n) for n, c in carry.items()]), [KEY, BLOCK])


def by_block(first: int | None = None, last: int | None = None) -> WindowSpec:
    """The blocks of a series from `first` to `last` beside the current one; None for all."""
    bounds = (Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)
    return Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(*bounds)


def integrate(blocks: DataFrame, values: dict[str, Column], dt: float) -> DataFrame:
    """Adds for each name the running integral of its value by trapezoids, 0 at the first row, and under name_whole that of the series.

    An area without both of its values counts as 0.
    """
    w = Window.partitionBy(KEY, BLOCK).orderBy(PLACE)
    names = list(values)
    made = blocks.withColumns({f"__v{k}": values[n] for k, n in enumerate(names)})
    area = lambda a, b: F.coalesce((a + b) / 2 * dt, F.lit(0.0))
    made = made.withColumns({f"__a{k}": area(F.lag(f"__v{k}").over(w), F.col(f"__v{k}")) for k in range(len(names))})
    summary, carry = {}, {}
    for k in range(len(names)):
        summary |= {f"__t{k}": F.sum(f"__a{k}"), f"__f{k}": F.min_by(f"__v{k}", PLACE), f"__l{k}": F.max_by(f"__v{k}", PLACE)}
        carry[f"__e{k}"] = area(F.lag(f"__l{k}").over(Window.partitionBy(KEY).orderBy(BLOCK)), F.col(f"__f{k}"))
    sums = made.groupBy(KEY, BLOCK).agg(*[c.alias(n) for n, c in summary.items()]).withColumns(carry)
    totals = [(F.sum(F.col(f"__t{k}") + F.col(f"__e{k}")).over(by_block(None, 0)) - F.col(f"__t{k}")).alias(f"__b{k}") for k in range(len(names))]
    totals += [F.sum(F.col(f"__t{k}") + F.col(f"__e{k}")).over(by_block()).alias(f"{n}_whole") for k, n in enumerate(names)]
    joined = made.join(sums.select(KEY, BLOCK, *totals), [KEY, BLOCK])
    out = joined.withColumns({n: F.col(f"__b{k}") + F.sum(f"__a{k}").over(inside()) for k, n in enumerate(names)})
    return out.drop(*[f"__{c}{k}" for c in "vab" for k in range(len(names))])


def remove_first_mean(blocks: DataFrame, value: str, first: int) -> DataFrame:
    """Subtract the mean of the first rows of the series, those before the arrival."""
    early = F.when(F.col(PLACE) < first, F.col(value))
    sums = {"__s": F.sum(early), "__n": F.count(early)}
    mean = F.sum("__s").over(by_block()) / F.nullif(F.sum("__n").over(by_block()), F.lit(0))
    return carried(blocks, sums, {"__mean": mean}).withColumn(value, F.col(value) - F.coalesce("__mean", F.lit(0.0))).drop("__mean")


def last_known(blocks: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds the last value that is known at or before each row."""
    made = blocks.withColumn("__v", value)
    seen = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(PLACE)))
    joined = carried(made, {"__last": seen}, {"__carry": F.last("__last", ignorenulls=True).over(by_block(None, -1))})
    return joined.withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inside()), "__carry")).drop("__v", "__carry")


def next_known(blocks: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds the first value that is known at or after each row."""
    made = blocks.withColumn("__v", value)
    seen = F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col(PLACE)))
    joined = carried(made, {"__first": seen}, {"__carry": F.first("__first", ignorenulls=True).over(by_block(1, None))})
    ahead = Window.partitionBy(KEY, BLOCK).orderBy(PLACE).rowsBetween(0, Window.unboundedFollowing)
    return joined.withColumn(out, F.coalesce(F.first("__v", ignorenulls=True).over(ahead), "__carry")).drop("__v", "__carry")


def interpolate(blocks: DataFrame, x: str, y: str) -> DataFrame:
    """Fill null `y` on the line between the known rows on both sides; beyond the ends the last known one."""
    knot = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    made = next_known(last_known(blocks, knot, "__p"), knot, "__q")
    p, q = F.col("__p"), F.col("__q")
    line = p["y"] + (q["y"] - p["y"]) * (F.col(x) - p["x"]) / F.nullif(q["x"] - p["x"], F.lit(0))
    return made.withColumn(y, F.coalesce(F.col(y), line, p["y"], q["y"])).drop("__p", "__q")


def with_edges(blocks: DataFrame, back: int, ahead: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row in the frame of its block and, within `back` or `ahead` of an edge, in that of the block which needs it too (__frame)."""
    if max(back, ahead) > block_rows:
        raise ValueError("a frame reaches at most one block far")
    at = F.pmod(F.col(PLACE), F.lit(block_rows))
    frames = F.array(F.col(BLOCK), F.when(at < ahead, F.col(BLOCK) - 1), F.when(at >= block_rows - back, F.col(BLOCK) + 1))
    return blocks.withColumn(FRAME, F.explode(F.array_compact(frames)))


def own_rows(framed: DataFrame) -> DataFrame:
    """The rows of the frames' own blocks, once each."""
    return framed.where(F.col(FRAME) == F.col(BLOCK)).drop(FRAME)


def along() -> WindowSpec:
    """The rows of a frame in their order."""
    return Window.partitionBy(KEY, FRAME).orderBy(PLACE)


def moving_statistics(blocks: DataFrame, value: str, width: int, mean: str, deviation: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred moving average and deviation over `width` rows, with zeros beyond the ends."""
    back, ahead = width // 2, width - 1 - width // 2
    w = along().rowsBetween(-back, ahead)
    made = with_edges(blocks, back, ahead, block_rows).withColumns({mean: F.sum(value).over(w) / width, "__sq": F.sum(F.col(value) * F.col(value)).over(w) / width})
    return own_rows(made.withColumn(deviation, F.sqrt(F.greatest(F.col("__sq") - F.col(mean) * F.col(mean), F.lit(0.0)))).drop("__sq"))


def sliding_likeness(blocks: DataFrame, a: str, b: str, width: int, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds 1 / sqrt(sum((a - b)^2) / (width - 1)) over the `width` rows from each one on; null where there are fewer, or no difference.

    A row without one of the values counts as no difference.
    """
    w = along().rowsBetween(0, width - 1)
    gap = F.coalesce(F.pow(F.col(a) - F.col(b), 2), F.lit(0.0))
    made = with_edges(blocks, 0, width - 1, block_rows).withColumns({"__s": F.sum(gap).over(w), "__n": F.count(F.lit(1)).over(w)})
    return own_rows(made.withColumn(out, F.when((F.col("__n") == width) & (F.col("__s") > 0), F.sqrt((width - 1) / F.nullif(F.col("__s"), F.lit(0.0))))).drop("__s", "__n"))


def nearest_shares(blocks: DataFrame, share: str, keys: list[str], steps: int = 10, out: str = "places") -> DataFrame:
    """One row for each series: the places whose running share is nearest to 1/steps, 2/steps, ... 1, the first on ties.

    One aggregate with a partial result in every task. A place is null where no share is known.
    """
    far = lambda k: F.when(F.col(share).isNotNull(), F.struct(F.abs(F.col(share) - k / steps).alias("d"), F.col(PLACE).alias("i")))
    found = blocks.groupBy(KEY).agg(*[F.min(far(k))["i"].alias(f"p{k}") for k in range(1, steps + 1)])
    return found.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.array(*[f"p{k}" for k in range(1, steps + 1)]).alias(out))
