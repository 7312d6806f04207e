"""Review decisions that arrive in any order, kept as one state for each pick.

A pick is pending until a decision makes it valid, discarded or postponed; a later decision replaces an earlier one,
whenever either arrives. A valid pick is corrected when a correction was made after its last decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tremorlake.streaming.keyed import Combine, KeyedTable

VERDICTS = ("valid", "discarded", "postponed")
CORRECTED = "corrected"

#: What is known of a pick after its decisions.
STATE = ("at", "position", "status", "method", "corrected")

#: Spark's store for states that need not fit the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def review_states(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, position, status, method, corrected) of all picks with a decision, from a whole table of decisions.

    `decisions` has the keys, at (a whole number that orders them), position, verdict and moved. The decision of the
    greatest `at` counts; of equal ones the greatest position, verdict and moved, null the least. Other verdicts and rows
    without `at` change nothing; repeated rows change nothing.
    """
    known = F.col("verdict").isin(*VERDICTS) & F.col("at").isNotNull()
    last = F.max(F.when(known, F.struct("at", "position", "verdict", "moved")))
    corrected = F.max(F.when(F.col("verdict") == CORRECTED, F.col("at")))
    held = decisions.groupBy(*keys).agg(last.alias("d"), corrected.alias("c")).where("d IS NOT NULL")
    return held.select(
        *keys, F.col("d.at").cast("long").alias("at"), F.col("d.position").cast("long").alias("position"), F.upper("d.verdict").alias("status"),
        F.when(F.col("d.moved"), "Manual").otherwise("Automatic").alias("method"), F.coalesce((F.col("d.verdict") == "valid") & (F.col("c") > F.col("d.at")), F.lit(False)).alias("corrected"),
    )


def counted(keys: tuple[str, ...]) -> Combine:
    """The new state of each pick where there is one, rows without `changes`; these count up for each new state that differs from the old one."""

    def combine(rows: DataFrame) -> DataFrame:
        state = F.struct(*STATE)
        old, new = (F.max(F.when(c, state)).alias(n) for c, n in ((F.col("changes").isNotNull(), "old"), (F.col("changes").isNull(), "new")))
        both = rows.groupBy(*keys).agg(old, new, F.max("changes").alias("changes"))
        changed = F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
        now = F.coalesce("new", "old")
        return both.select(*keys, (F.coalesce("changes", F.lit(0)) + changed.cast("long")).alias("changes"), *[now[c].alias(c) for c in STATE])

    return combine


def keep_reviews(decisions: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """A stream of decisions kept as a table of picks by key; ends when all that is there is read.

    The aggregate of `review_states` goes on from batch to batch, its last decision and correction of each pick in Spark's
    state store; the table gets the picks that a batch has decisions of, and counts their `changes`. It equals `review_states`
    of all decisions, whatever their order and however often they come. Started again, it goes on from its checkpoint:
    decisions that were read are not read again, and a batch that failed is merged once. Sets the session's state store.
    """
    decisions.sparkSession.conf.set(*STATE_STORE)
    combine = counted(table.keys)

    def merge(batch: DataFrame, number: int) -> None:
        # Kept while it is merged: else each look at it would run the aggregate again.
        held = batch.withColumn("changes", F.lit(None).cast("long")).persist()
        try:
            table.merge(held, number, combine)
        finally:
            held.unpersist()

    named = decisions.withColumns({c: F.col(c).cast("long") for c in ("at", "position")})
    return (
        review_states(named, list(table.keys)).writeStream.outputMode("update")
        .foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
