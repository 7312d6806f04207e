"""Column builders for catalogue text and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """Unknown numbers are null inside; Spark orders NaN above all numbers."""
    return F.when(~F.isnan(c), c)


def falsy_to_null(c: Column) -> Column:
    """Zero and null both mean unknown."""
    return F.when(c != 0, c)


def number_or_sentinel(c: Column, sentinel: float = -1.0) -> Column:
    """A number from text that may also hold a remark; the sentinel for the latter."""
    return F.coalesce(c.try_cast("double"), F.lit(sentinel))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def event_id(date: Column, magnitude: Column, latitude: Column, longitude: Column, depth: Column) -> Column:
    """`YYYYMMDD_<mag>M_<lat>S_<lon>W_<depth>KM` from texts; a missing part leaves its letters only."""
    part = lambda value, missing, unit: F.coalesce(F.concat(value, F.lit(unit)), F.lit(missing))
    return F.concat_ws(
        "_", F.date_format(date, "yyyyMMdd"), part(magnitude, "magM", "M"), part(latitude, "latS", "S"), part(longitude, "lonW", "W"), part(depth, "depthKM", "KM")
    )


def parsed_event_id(c: Column) -> dict[str, Column]:
    """The parts of an event id, of which the type may follow; parts that it lacks are null."""
    piece = lambda i, unit: F.regexp_replace(F.split_part(c, F.lit("_"), F.lit(i)), f"{unit}$", "").try_cast("double")
    day = F.split_part(c, F.lit("_"), F.lit(1))
    return {"date": F.to_date(day, "yyyyMMdd"), "magnitude": piece(2, "M"), "latitude": -piece(3, "S"), "longitude": -piece(4, "W"), "depth": piece(5, "KM"), "type": capitalised(F.nullif(F.split_part(c, F.lit("_"), F.lit(6)), F.lit("")))}


def rupture_pair(rrup: Column, rjb: Column, sentinel: float = -1.0) -> tuple[Column, Column]:
    """Distances to a rupture as numbers from text; a remark in place of the first makes both unknown, null stays null."""
    remark = rrup.isNotNull() & rrup.try_cast("double").isNull()
    return tuple(F.when(remark, sentinel).when(c.isNotNull(), number_or_sentinel(c, sentinel)) for c in (rrup, rjb))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
