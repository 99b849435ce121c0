"""How often each value shows, and the batches in which that is out of line.

Unlike the profiles, which know a value once, this counts every event. A value's history is three sums over the
earlier batches that show it: their number, the events, and the squares of the events. Such sums merge in any order,
so they are pre-aggregated and a running total over blocks of batches gives each batch its history; no task
holds a value's history as a list. The test is in whole numbers and free of rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators.profilers import (
    DEVIATION,
    Profiler,
    enriched,
    expanded,
    field_values,
    profiled_fields,
    wanted,
    with_places_once,
)
from vigilog.operators.profiles import running_totals
from vigilog.session import staged

#: Batches a value needs before its frequency is judged, and standard deviations that are still in line.
LEAST_BATCHES, DEVIATIONS = 5, 3


def frequencies(
    events: DataFrame,
    profilers: list[Profiler],
    blocks: DataFrame | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """``(profiler, batch_id, value, n)``: the events of each batch that show a value, per deviation profiler.

    An event that shows a value several times counts once.
    """
    chosen = [p for p in profilers if p.kind == DEVIATION]
    pairs = wanted(field_values(events, profiled_fields(chosen), "batch_id"), chosen)
    counted = pairs.groupBy("batch_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    if any(p.uses("city", "country") for p in chosen):
        rows = with_places_once(staged(counted, "counted"), chosen, blocks, nodes)
    else:
        rows = enriched(counted, chosen, blocks, nodes)
    shown = expanded(rows, chosen, "batch_id", "n")
    return shown.groupBy("profiler", "batch_id", "value").agg(F.sum("n").alias("n"))


def frequency_history(counts: DataFrame) -> DataFrame:
    """``counts`` with ``batches``, ``events`` and ``squares`` of the earlier batches that show the value."""
    keyed = counts.select(
        F.struct("profiler", "value").alias("key"), "batch_id", "n",
        F.lit(1).cast("bigint").alias("one"), (F.col("n") * F.col("n")).alias("square"),
    )
    sums = {"one": "batches", "n": "events", "square": "squares"}
    totals = running_totals(keyed, "key", "batch_id", sums)
    return totals.select(
        "key.profiler", "key.value", "batch_id", "n",
        (F.col("batches") - 1).alias("batches"), (F.col("events") - F.col("n")).alias("events"),
        (F.col("squares") - F.col("square")).alias("squares"),
    )


def frequency_alerts(
    counts: DataFrame, least_batches: int = LEAST_BATCHES, deviations: int = DEVIATIONS
) -> DataFrame:
    """The rows of :func:`frequency_history` whose ``n`` is more than ``deviations`` away from the mean.

    With the sums N, S and Q of the history, ``(N n - S)^2 > deviations^2 (N Q - S^2)``; a value that always
    showed equally often is out of line with any other count.
    """
    away = F.col("batches") * F.col("n") - F.col("events")
    spread = F.col("batches") * F.col("squares") - F.col("events") * F.col("events")
    history = frequency_history(counts).filter(F.col("batches") >= least_batches)
    return history.filter(away * away > deviations * deviations * spread).withColumn("more", away > 0)
