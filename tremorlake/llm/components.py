"""Connected components of a graph held as a table of edges, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.runtime import cut, drop_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of `edges` (u, v: long); component is the least id reachable.

    Alternates large-star and small-star steps, each an aggregate and a join, until the edges
    are stars around the least vertices. A vertex of many edges is never gathered in one row.
    Rounds end with the first table of stars, after about log^2 of the number of vertices; that
    it is one is seen from its vertices, without a further round that changes nothing.
    """
    work = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(work):
        before, work = work, cut(_small_star(_large_star(work)))
        drop_cut(before)
    return work.select(F.explode(F.array("u", "v")).alias("id"), F.col("v").alias("component")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) are stars around their least vertices: each u has one edge and is no v."""
    ends = edges.select(F.posexplode(F.array("u", "v")).alias("down", "id"))
    each = ends.groupBy("id").agg(F.sum(1 - F.col("down")).alias("up"), F.max("down").alias("down"))
    return not each.agg(F.max(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to its least one (itself included): a row (u > v) for each edge (u > v), some equal."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to its least one; of edges (u > v) again such edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
