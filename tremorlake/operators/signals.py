"""Ordered series as window functions, one row for each sample, within a record."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Fixed value: standard gravity as the records use it, m/s^2.
GRAVITY = 9.81


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def cumulative_trapezoid(value: Column, dt: float, w: WindowSpec) -> Column:
    """The running integral; 0 at the first sample."""
    area = F.coalesce((value + F.lag(value).over(w)) / 2 * dt, F.lit(0.0))
    return area


def integrate(df: DataFrame, value: str, out: str, dt: float, keys: list[str], order: list[str]) -> DataFrame:
    w = ordered(keys, order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = df.withColumn("__area", cumulative_trapezoid(F.col(value), dt, w))
    return step.withColumn(out, F.sum("__area").over(running)).drop("__area")


def remove_first_mean(df: DataFrame, value: str, first: int, keys: list[str], order: list[str]) -> DataFrame:
    """Subtract the mean of the first samples, those before the arrival."""
    numbered = df.withColumn("__i", F.row_number().over(ordered(keys, order)) - 1)
    mean = F.avg(F.when(F.col("__i") < first, F.col(value))).over(Window.partitionBy(*keys))
    return numbered.withColumn(value, F.col(value) - F.coalesce(mean, F.lit(0.0))).drop("__i")


def moving_average(value: Column, width: int, keys: list[str], order: list[str]) -> Column:
    """Centred, over `width` samples, with zeros beyond the ends."""
    frame = ordered(keys, order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return F.sum(value).over(frame) / width


def moving_deviation(value: Column, width: int, keys: list[str], order: list[str]) -> Column:
    mean = moving_average(value, width, keys, order)
    return F.sqrt(F.greatest(moving_average(value * value, width, keys, order) - mean * mean, F.lit(0.0)))


def gradient(value: Column, dt: float, w: WindowSpec) -> Column:
    """Central differences; at the ends one-sided ones of second order."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first = (-3 * value + 4 * after - F.lead(value, 2).over(w)) / (2 * dt)
    last = (3 * value - 4 * before + F.lag(value, 2).over(w)) / (2 * dt)
    return F.when(before.isNull(), first).when(after.isNull(), last).otherwise((after - before) / (2 * dt))


def interpolate(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Fill null `y` on the line between the known samples on both sides; beyond the ends the last known one."""
    back = ordered(keys, [x]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered(keys, [x]).rowsBetween(0, Window.unboundedFollowing)
    knot = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    df = df.withColumns({"__a": F.last(knot, ignorenulls=True).over(back), "__b": F.first(knot, ignorenulls=True).over(ahead)})
    a, b = F.col("__a"), F.col("__b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0))
    return df.withColumn(y, F.coalesce(F.col(y), line, a["y"], b["y"])).drop("__a", "__b")


def intensity(df: DataFrame, value: str, dt: float, keys: list[str], order: list[str]) -> DataFrame:
    """Arias intensity and its share of the whole, and cumulative absolute velocity, at each sample."""
    made = df.withColumns({"__sq": F.col(value) * F.col(value), "__abs": F.abs(value)})
    made = integrate(integrate(made, "__sq", "__energy", dt, keys, order), "__abs", "cav", dt, keys, order)
    whole = F.max("__energy").over(Window.partitionBy(*keys))
    made = made.withColumns({"arias": F.col("__energy") * (math.pi / (2 * GRAVITY)), "energy_share": F.col("__energy") / F.nullif(whole, F.lit(0.0))})
    return made.drop("__sq", "__abs", "__energy")
