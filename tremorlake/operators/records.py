"""Assembly of records: components from channels, fallbacks of fields, alignment in time, positions in arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of channels by component (fixed values).
X_CHANNELS = ("LONGITUDINAL", "350", "NORTH-SOUTH", "340", "290 DEG", "100", "140", "170", "280", "160", "290", "100 DEGREES", "L", "NS", "N-S", "HNN", "HN1", "HLN")
Y_CHANNELS = ("TRANSVERSE", "80", "EAST-WEST", "70", "200 DEG", "190", "10", "080", "50", "200", "010 DEGREES", "T", "EW", "E-W", "HLE", "HN2", "HNE")
Z_CHANNELS = ("VERTICAL", "UP", "V", "Z", "NZ", "HLZ", "HNZ")
OMITTED = ("INTC",)


def component_of(channel: Column) -> Column:
    """1, 2 or 3 (vertical) by the name of a channel; null for others and omitted ones."""
    name = F.trim(channel)
    return F.when(name.isin(*OMITTED), None).when(name.isin(*X_CHANNELS), 1).when(name.isin(*Y_CHANNELS), 2).when(name.isin(*Z_CHANNELS), 3)


def components(channels: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row for each key: channel_k and the values of component k, of several channels the last by `order`."""
    found = channels.withColumn("__k", component_of(F.col("channel"))).where("__k IS NOT NULL")
    held = F.struct(F.trim("channel").alias("channel"), *values)
    made = found.groupBy(*keys).agg(*[F.max_by(F.when(F.col("__k") == k, held), F.when(F.col("__k") == k, F.col(order))).alias(f"__{k}") for k in (1, 2, 3)])
    return made.select(*keys, *[F.col(f"__{k}.{c}").alias(f"{c}_{k}") for k in (1, 2, 3) for c in ("channel", *values)])


def mean_step(times: Column) -> Column:
    """Mean step in seconds of an array of sorted times; null for fewer than two."""
    n = F.size(times) - 1
    return F.when(n > 0, (F.unix_micros(F.element_at(times, -1).cast("timestamp")) - F.unix_micros(F.element_at(times, 1).cast("timestamp"))) / (n * 1e6))


def field(names: list[str], name: str) -> Column:
    """A field of the first of several structs that is not null."""
    return F.coalesce(*[F.col(n) for n in names])[name]


def with_station_defaults(records: DataFrame, stations: DataFrame, code: str) -> DataFrame:
    """Vs30 and azimuth of the station table (0 is unknown), its name or Unknown; hvsr is not known yet.

    Longitude and latitude of the record come first, then those of the table.
    """
    known = stations.select(F.col(code), F.nullif("vs30", F.lit(0)).alias("vs30"), F.nullif("azimuth", F.lit(0)).alias("azimuth"), F.col("name").alias("station_name"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    joined = records.join(known, code, "left")
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return joined.withColumns({
        "station_name": F.coalesce("station_name", F.lit("Unknown")), "hvsr": F.lit("Undetermined"),
        "lat": F.when(both, F.col("lat")).otherwise(F.col("__lat")), "lon": F.when(both, F.col("lon")).otherwise(F.col("__lon")),
    }).drop("__lat", "__lon")


def aligned(values: list[str], starts: list[str], dt: Column) -> dict[str, Column]:
    """Components with zeros before those that start later, int(delay / dt) of them, and after them up to one length.

    A missing component stays missing and has no say in the first start.
    """
    # Times in seconds; the first start is that of the components that are there.
    first = F.least(*[F.when(F.col(v).isNotNull(), F.col(s)) for v, s in zip(values, starts, strict=True)])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    led = {v: F.concat(zeros(F.floor((F.col(s) - first) / dt).cast("int")), F.col(v)) for v, s in zip(values, starts, strict=True)}
    length = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in led.values()])
    return {v: F.when(F.col(v).isNotNull(), F.concat(c, zeros(length - F.size(c)))) for v, c in led.items()}


def ordinals(rows: DataFrame, event: str, order: list[str], prefix: str = "st") -> Column:
    """st00, st01, ... within an event."""
    k = F.row_number().over(Window.partitionBy(event).orderBy(*order)) - 1
    return F.concat(F.lit(prefix), F.when(k < 100, F.lpad(k.cast("string"), 2, "0")).otherwise(k.cast("string")))


def first_where(values: Column, test) -> Column:
    """The first place, from 0, at which a value meets `test`; null for none."""
    return F.array_min(_places(values, test))


def last_where(values: Column, test) -> Column:
    return F.array_max(_places(values, test))


def _places(values: Column, test) -> Column:
    return F.filter(F.transform(values, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())


def interior(values: Column) -> Column:
    """All but the first and the last element."""
    return F.slice(values, 2, F.greatest(F.size(values) - 2, F.lit(0)))


def square_bounds(points: DataFrame, key: str, x: str, y: str, margin: float = 30_000.0) -> DataFrame:
    """The square around all points of a key, widened by a margin on every side."""
    box = points.groupBy(key).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2 + margin
    at = lambda a, b, sign: ((F.col(a) + F.col(b)) / 2 + sign * half)
    return box.select(key, at("x0", "x1", -1).alias("xmin"), at("x0", "x1", 1).alias("xmax"), at("y0", "y1", -1).alias("ymin"), at("y0", "y1", 1).alias("ymax"))


def period_grid(low: float, high: float, points: int) -> Column:
    """Sorted periods, half of them evenly spaced and half of them by ratio; the latter start at 0.001 at least."""
    half = points // 2
    start, stop = math.log10(max(low, 0.001)), math.log10(high)
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    ratio = F.transform(steps, lambda i: F.pow(F.lit(10.0), start + i * ((stop - start) / (half - 1))))
    even = F.transform(steps, lambda i: low + i * ((high - low) / (half - 1)))
    return F.array_sort(F.array_distinct(F.concat(ratio, even)))


def velocity_spectrum(sa: Column, periods: Column) -> Column:
    """Sa T / 2 pi, period by period."""
    return F.zip_with(sa, periods, lambda s, t: s * t / (2 * math.pi))
