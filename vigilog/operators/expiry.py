"""Profiles whose values expire: a value that stays away for more than ``ttl`` batches is new again.

All that matters is the batch that last showed a value before, a lag along the batches. Like the running totals it
is taken in two levels, within blocks of batches and then over one row per block, so that a value that shows in
every batch of a long history does not put its history into one task.

Defined cases: a null value is a value like any other; a batch without activity counts as time that passes; a
``ttl`` of 0 forgets all but the batch before; no observations give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.operators.profilers import DEVIATION
from vigilog.operators.profiles import BLOCK, baselines


def with_previous(seen: DataFrame) -> DataFrame:
    """``(profiler, batch_id, value, previous)``: the last batch before that showed the value, null for the first.

    The first row of each block takes its predecessor from the block totals, all others from their own block, so
    the two levels are disjoint and need no join.
    """
    rows = seen.filter(F.col("kind") == DEVIATION).select(
        "profiler", "batch_id", "value", F.floor(F.col("batch_id") / BLOCK).alias("_block")
    )
    within = Window.partitionBy("profiler", "value", "_block").orderBy("batch_id")
    inner = rows.withColumn("previous", F.lag("batch_id").over(within)).filter("previous is not null")
    blocks = rows.groupBy("profiler", "value", "_block").agg(
        F.min("batch_id").alias("batch_id"), F.max("batch_id").alias("_last")
    )
    over = Window.partitionBy("profiler", "value").orderBy("_block")
    heads = blocks.withColumn("previous", F.lag("_last").over(over))
    return inner.drop("_block").unionByName(heads.drop("_block", "_last"))


def expired_values(seen: DataFrame, ttl: int) -> DataFrame:
    """``(profiler, value, last_batch, expired_at, returned_at)``: each time a value left its profile.

    ``expired_at`` is the first batch whose profile lacks it; ``returned_at`` is null while it stays away. What
    would leave after the last batch of the history has not expired.
    """
    returned = with_previous(seen).filter(F.col("batch_id") - F.col("previous") > ttl + 1).select(
        "profiler", "value", F.col("previous").alias("last_batch"), F.col("batch_id").alias("returned_at")
    )
    shown = seen.filter(F.col("kind") == DEVIATION)
    # One row, so safe to broadcast.
    end = F.broadcast(shown.agg(F.max("batch_id").alias("_end")))
    gone = (
        shown.groupBy("profiler", "value")
        .agg(F.max("batch_id").alias("last_batch"))
        .join(end, F.col("last_batch") + ttl + 2 <= F.col("_end"))
        .select("profiler", "value", "last_batch", F.lit(None).cast("bigint").alias("returned_at"))
    )
    expired = returned.unionByName(gone)
    return expired.withColumn("expired_at", F.col("last_batch") + ttl + 2).select(
        "profiler", "value", "last_batch", "expired_at", "returned_at"
    )


def expiring_counts(seen: DataFrame, ttl: int) -> DataFrame:
    """``(profiler, batch_id, n_current, n_new, n_returned, alerts)`` against profiles that expire.

    A returned value is one that had expired. Both kinds alert in any batch after the baseline.
    """
    returned = F.col("batch_id") - F.col("previous") > ttl + 1
    counts = with_previous(seen).groupBy("profiler", "batch_id").agg(
        F.count(F.lit(1)).alias("n_current"),
        F.count_if(F.col("previous").isNull()).alias("n_new"),
        F.count_if(returned).alias("n_returned"),
    )
    deviating = (F.col("n_new") + F.col("n_returned") > 0) & (F.col("batch_id") > F.col("baseline"))
    return counts.join(baselines(seen), "profiler").withColumn("alerts", deviating).drop("baseline")
