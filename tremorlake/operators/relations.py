"""Relational operators of catalogue curation: change detection, upserts, overlays, merges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.lineage import checkpointed, dropped


def new_or_changed(current: DataFrame, computed: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of `current` whose key is missing in `computed` or has only other versions there (null differs from a value).

    A key that `computed` repeats gives no row of `current` twice.
    """
    seen = computed.groupBy(*keys).agg(F.collect_set(version).alias("__seen"), F.count_if(F.col(version).isNull()).alias("__nulls"))
    same = F.when(F.col(version).isNull(), F.col("__nulls") > 0).otherwise(F.array_contains("__seen", F.col(version)))
    return current.join(seen, keys, "left").where(~F.coalesce(same, F.lit(False))).select(current.columns)


def drop_all_copies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the values of `columns` that occur once: every copy of a repeated row goes."""
    return df.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of `new`, and of `old` the rows whose key `new` lacks; also the draft-over-main overlay."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def union_catalogues(sources: dict[str, DataFrame], label: str) -> DataFrame:
    """All rows with the name of their source; columns that a source lacks are null."""
    named = [df.withColumn(label, F.lit(name)) for name, df in sources.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def merge_lists(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """Both sides by key; the sorted union of their `"; "`-separated items."""
    split = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "; "))
    joined = old.select(key, F.col(items).alias("__a")).join(new.select(key, F.col(items).alias("__b")), key, "full")
    merged = F.array_sort(F.array_union(split(F.col("__a")), split(F.col("__b"))))
    return joined.select(key, F.array_join(merged, "; ").alias(items))


def filter_catalogue(
    df: DataFrame, ranges: dict[str, tuple[object, object]], equal: dict[str, str | None]
) -> DataFrame:
    """Rows inside all inclusive ranges whose texts are equal but for case; `None` or `Any` ask for nothing."""
    for name, (low, high) in ranges.items():
        df = df.where(F.col(name).between(low, high))
    for name, value in equal.items():
        if value not in (None, "Any"):
            df = df.where(F.lower(F.col(name)) == value.lower())
    return df


#: Rows of a grid that are broadcast at once.
GRID_BLOCK = 200_000


def nearest(left: DataFrame, grid: DataFrame, left_key: str, distance: Column, take: list[str], order: str, block: int = GRID_BLOCK) -> DataFrame:
    """For each left row the grid row of least distance, the first by `order` on ties.

    For any expression of distance: each left row meets all of the grid, one of more than `block` rows
    in blocks of about that size, whose winners meet again. `nearest_in_plane` takes cells instead.
    """
    blocks = -(-grid.count() // block) or 1
    rank = F.struct("__d", order)
    number = F.pmod(F.xxhash64(*grid.columns), F.lit(blocks))
    found = None
    for k in range(blocks):
        joined = left.crossJoin(F.broadcast(grid.where(number == k) if blocks > 1 else grid)).withColumn("__d", distance).where("__d IS NOT NULL")
        won = joined.groupBy(left_key).agg(F.min(rank).alias("__rank"), F.min_by(F.struct(*take), rank).alias("__best"))
        found = won if found is None else found.unionByName(won)
    best = found.groupBy(left_key).agg(F.min_by("__best", "__rank").alias("__best")) if blocks > 1 else found
    return best.select(left_key, *[F.col(f"__best.{c}").alias(c) for c in take])


def _finite(name: str) -> Column:
    return F.coalesce(F.abs(F.col(name)) < float("inf"), F.lit(False))


def nearest_in_plane(left: DataFrame, grid: DataFrame, left_key: str, place: tuple[str, str], at: tuple[str, str], take: list[str], order: str) -> DataFrame:
    """For each left row with a place the grid row of least Euclidean distance in the plane, the first by `order` on ties.

    Places are looked up once each. They meet the grid rows of their own cell and the eight around it, by an equi-join;
    what lies nearer than the width of a cell is found there. Places without such a row go on with cells of twice the
    width, so that a hole of the grid or a place far from it costs more only there; places outside of the grid begin with
    their distance from it. Rows without a place, or with one that is NaN or infinite, have none, and such grid rows count for none.
    """
    x, y = (F.col(c).cast("double") for c in place)
    places = left.select(x.alias("__x"), y.alias("__y")).where(_finite("__x") & _finite("__y")).distinct()
    points = grid.select(F.col(at[0]).cast("double").alias("__gx"), F.col(at[1]).cast("double").alias("__gy"), F.struct(F.col(order).alias("__o"), *take).alias("__row"))
    points = points.where(_finite("__gx") & _finite("__gy"))
    x0, x1, y0, y1, n = points.selectExpr("min(__gx)", "max(__gx)", "min(__gy)", "max(__gy)", "count(*)").first()
    if not n:
        return left.join(grid.select(*take), F.lit(False), "left").select(left_key, *take).limit(0)
    # About one row to a cell at first; a width over `whole` holds all rows in the cells around any place.
    width = max((x1 - x0) / n**0.5, (y1 - y0) / n**0.5, 1e-9)
    beyond = lambda c, low, high: F.greatest(F.lit(low) - F.col(c), F.col(c) - F.lit(high), F.lit(0.0))
    outside = F.greatest(beyond("__x", x0, x1), beyond("__y", y0, y1))
    extent = max(x1 - x0, y1 - y0)
    found, rest = None, places
    while True:
        left_over, least, most = rest.agg(F.count("*"), F.min(outside), F.max(outside)).first()
        if not left_over:
            break
        # No row is nearer than the box of the grid.
        width = max(width, least)
        whole = width > 1.01 * (most + extent) or math.isinf(width)
        # Cells are counted from the corner of the grid; what would not fit in a long is far from all of them.
        cell = lambda c, low, w=width: F.floor(F.least(F.greatest((F.col(c) - low) / w, F.lit(-(2.0**60))), F.lit(2.0**60)))
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asked = rest.withColumn("__dx", around).withColumn("__dy", around)
        asked = asked.withColumns({"__cx": cell("__x", x0) + F.col("__dx"), "__cy": cell("__y", y0) + F.col("__dy")})
        held = points.withColumns({"__cx": cell("__gx", x0), "__cy": cell("__gy", y0)})
        distance = F.pow(F.col("__gx") - F.col("__x"), 2) + F.pow(F.col("__gy") - F.col("__y"), 2)
        rank = F.struct(distance.alias("d"), "__row")
        best = asked.join(held, ["__cx", "__cy"]).groupBy("__x", "__y").agg(F.min(rank).alias("__best"))
        best = checkpointed(best if whole else best.where(F.col("__best.d") < 0.99 * width * width))
        found = best if found is None else found.unionByName(best)
        if whole:
            break
        last, rest = rest, checkpointed(rest.join(best, ["__x", "__y"], "left_anti"))
        if last is not places:
            dropped(last)
        width *= 2
    if found is None:
        return left.join(grid.select(*take), F.lit(False), "left").select(left_key, *take).limit(0)
    joined = left.withColumns({"__x": x, "__y": y}).join(found, ["__x", "__y"])
    return joined.select(left_key, *[F.col(f"__best.__row.{c}").alias(c) for c in take])


def nearest_sample(values: Column, dt: float, time: Column, level: Column) -> Column:
    """The sample of a record closest to the point (time, level), the first on ties; null for an empty record."""
    far = lambda v, i: F.struct((F.pow(i * dt - time, 2) + F.pow(v - level, 2)).alias("d"), i.alias("i"))
    return F.array_min(F.transform(values, far))["i"]


def apply_decisions(state: DataFrame, decisions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state of picks after review: the last decision of each key, by `order`, sets position, status and method.

    `decisions` has keys, order, position, verdict (valid, discarded or postponed; others change
    nothing) and moved: the method is Manual where the reviewer moved the pick, else Automatic.
    Keys that the state lacks are added; other columns of the state stay.
    """
    known = decisions.where("verdict IN ('valid', 'discarded', 'postponed')")
    last = known.groupBy(*keys).agg(F.max_by(F.struct("position", "verdict", "moved"), order).alias("__last"))
    joined = state.join(last, keys, "full")
    decided, new = F.col("__last").isNotNull(), {
        "position": F.col("__last.position"), "status": F.upper("__last.verdict"), "method": F.when(F.col("__last.moved"), "Manual").otherwise("Automatic")
    }
    return joined.withColumns({c: F.when(decided, v).otherwise(F.col(c)) for c, v in new.items()}).select(*state.columns)
