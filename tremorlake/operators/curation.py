"""Filters, lookups and joins over flat files, review states and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators import scans

# --- review states: status is null (pending), "true", "false" or "postponed"


def is_pending(status: Column) -> Column:
    return status.isNull()


def is_postponed(status: Column) -> Column:
    return F.coalesce(~status.isin("true", "false"), F.lit(False))


def ready_to_correct(status: Column, corrected: Column) -> Column:
    """Valid and not yet corrected; an unknown flag counts as not corrected."""
    return F.coalesce(status == "true", F.lit(False)) & ~F.coalesce(corrected, F.lit(False))


def is_shown(status: Column) -> Column:
    """All but pending and discarded ones, postponed ones included."""
    return F.coalesce(status != "false", F.lit(False))


def needs_download(status: Column) -> Column:
    """Not yet decided: neither true nor false."""
    return ~F.coalesce(status.isin("true", "false"), F.lit(False))


# --- flat file


def without_zone(text: Column) -> Column:
    """A time stamp as text, its `T` as a space and without a final `Z`."""
    return F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", "")


def cast_block(df: DataFrame, floats: list[str], dates: list[str], timestamps: list[str]) -> DataFrame:
    """Text columns as numbers, dates and times; what cannot be read is null."""
    to = {c: F.col(c).try_cast("double") for c in floats}
    to |= {c: F.col(c).try_cast("timestamp_ntz").cast("date") for c in dates}
    to |= {c: without_zone(F.col(c)).try_cast("timestamp_ntz") for c in timestamps}
    return df.withColumns(to)


def lacks_distances(distances: list[Column], inputs: list[Column]) -> Column:
    """Not all distances are known and 0 or more, and nothing is missing to work them out."""
    known = [F.coalesce(d >= 0, F.lit(False)) for d in distances]
    there = [i.isNotNull() for i in inputs]
    every = lambda cs: F.forall(F.array(*cs), lambda c: c)
    return ~every(known) & every(there)


def differs(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Numbers as text that are `tolerance` or more apart; other text is -1, a missing number differs from all."""
    number = lambda c: F.when(c.isNull(), None).otherwise(F.coalesce(c.try_cast("double"), F.lit(-1.0)))
    return ~F.coalesce(F.abs(number(a) - number(b)) < tolerance, F.lit(False))


def refresh(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`rows` with the values of `changes`, one row for each key, where these are known."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(rows.columns)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def first_copies(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a list for people, counted from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def size_text(bytes_: Column) -> Column:
    """MB below 1024 of them, else GB, with two decimals."""
    mb = bytes_ / (1 << 20)
    return F.when(mb < 1024, F.concat(F.format_string("%.2f", mb), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.2f", mb / 1024), F.lit(" GB")))


# --- joins by order and by range


def as_of(samples: DataFrame, boundaries: DataFrame, key: str, x: str, values: list[str], block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """Samples with the values of the last boundary of their key at or before x; null before the first one.

    One union in blocks of equal size, from each of which the last boundary is carried on: a key of any number of rows
    lies in many tasks. Of boundaries at one x the one of the greatest values counts; null keys are a key of their own.
    """
    held = F.struct(*values)
    tagged = samples.withColumns({"__b": F.lit(None).cast(boundaries.select(held.alias("b")).schema["b"].dataType), "__late": F.lit(1)})
    knots = boundaries.select(key, x, held.alias("__b"), F.lit(0).alias("__late"))
    blocks = scans.in_blocks(tagged.unionByName(knots, allowMissingColumns=True), [key], [x, "__late", "__b"], block_rows)
    found = scans.last_known(blocks, F.col("__b"), "__found").where("__late = 1")
    return found.select(*samples.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


#: Cells are counted up to this far from 0: what lies beyond meets in the last one.
FAR_CELL = 1 << 60


def _cell(c: Column, width: float) -> Column:
    return F.floor(F.least(F.greatest(c / width, F.lit(-float(FAR_CELL))), F.lit(float(FAR_CELL))))


def dyadic_cells(low: Column, high: Column) -> Column:
    """Array of (level, cell) of the fewest cells of 2^level units that make up the units from `low` to `high`, both included.

    At most two of each level: the left one where the first whole cell is odd, the right one where the last one is even.
    """

    def of_level(level: Column) -> Column:
        shifted = lambda c: F.call_function("shiftright", c, level)
        first, end = -shifted(-low), shifted(high + 1)
        left, right = F.when((first < end) & (F.pmod(first, F.lit(2)) == 1), first), F.when((first < end) & (F.pmod(end, F.lit(2)) == 1), end - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(61)), of_level))


def within_segments(samples: DataFrame, segments: DataFrame, key: str, x: str, low: str, high: str, width: float) -> DataFrame:
    """Each sample with each segment of its key whose [low, high], both ends included, holds its x.

    An equi-join on key, level and cell: a segment, however long, is at most two cells of each level, thus two for each
    doubling of its length over `width`; a sample is asked for in one cell of each level that segments have. A segment with a
    null or NaN end, or that ends before it begins, holds nothing; one without bounds ends at infinity. A key with very many
    samples is spread by cells. `width` only sets the unit, not the result.
    """
    sound = segments.where(F.col(low) <= F.col(high)).where(~F.isnan(F.col(high).cast("double")))
    cut = sound.withColumn("__c", F.explode(dyadic_cells(_cell(F.col(low), width), _cell(F.col(high), width))))
    cells = cut.withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())
    asked = samples.where(F.col(x).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("__cell", F.call_function("shiftright", _cell(F.col(x), width), F.col("__level")))
    joined = asked.join(cells, [key, "__level", "__cell"])
    return joined.where(F.col(x).between(F.col(low), F.col(high))).drop("__level", "__cell")


#: Parts that the files of each name are dealt to.
SHARES = 64


def match_channels(files: DataFrame, traces: DataFrame, keys: list[str], shares: int = SHARES) -> DataFrame:
    """Channels of files with the traces of that name, or of a number whose chan_id is that name.

    There are few keys and names, and each meets all traces of its own: the files of a name are dealt to `shares` parts,
    and each trace goes to all of them, so that the pairs come from all tasks. A number of partitions is given, or else
    adaptive execution joins the few bytes that go in, and all pairs, in one task.
    """
    number = F.col("channel").rlike("^[0-9]+$") & (F.col("chan_id").isNotNull())
    names = F.array_compact(F.array_distinct(F.array(F.col("channel"), F.when(number, F.col("chan_id")))))
    named = traces.withColumn("__name", F.explode(names)).withColumnRenamed("channel", "trace_channel")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = named.withColumn("__share", F.explode(F.array(*map(F.lit, range(shares))))).repartition(tasks, *keys, "__name", "__share")
    dealt = files.withColumns({"__name": F.col("channel"), "__share": F.pmod(F.xxhash64(*files.columns), F.lit(shares)).cast("int")}).repartition(tasks, *keys, "__name", "__share")
    added = [c for c in named.columns if c not in (*keys, "trace_channel", "chan_id", "__name")]
    # Neither side is sent whole to all tasks: both grow.
    joined = dealt.alias("f").join(every.alias("t").hint("merge"), [F.col(f"f.{c}") == F.col(f"t.{c}") for c in (*keys, "__name", "__share")])
    return joined.select(*[F.col(f"f.{c}") for c in files.columns], "t.trace_channel", "t.chan_id", *[F.col(f"t.{c}") for c in added])


def group_changes(rows: DataFrame, key: str, order: list[str], within: list[str]) -> DataFrame:
    """Adds starts (a new key begins here) and run (the number of the run of one key), in an order within groups."""
    w = Window.partitionBy(*within).orderBy(*order)
    starts = ~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("starts", starts)
    return marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
