"""The profile analyzer as a stream.

Spark's keyed state holds the first and last time each (field, value) was seen.
Every batch it emits the values the batch touched; a value is new when both
times are the batch's own. So a batch costs what it touches, however large the
profiles have grown, and a hot value is folded before the shuffle.

Values that pass through unchanged take their newness from that state. Where a
lookup decides what a profile value is or whether it is kept, values are compared
with the stored profile of that one profiler: an address seen long ago is new to a
profile on the day that a list first names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog import schemas
from vigilog.operators.alerts import (
    VALUES_PER_PART,
    deviation_messages,
    sections_of,
    sighting_messages,
)
from vigilog.operators.geo import prefix_lengths
from vigilog.operators.profilers import (
    DEFAULT_PROFILERS,
    DEVIATION,
    SIGHTING,
    Profiler,
    enriched,
    expanded,
    field_values,
    profiled_fields,
    wanted,
)
from vigilog.operators.profiles import status_line
from vigilog.session import ROCKSDB_PROVIDER
from vigilog.streaming.store import Store

#: Batches between two merges of the stored profiles.
MERGE_EVERY = 64

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

Table = DataFrame | Callable[[], DataFrame] | None


def touched_values(events: DataFrame, profilers: list[Profiler]) -> DataFrame:
    """Streaming ``(field, value, first_seen, last_seen)`` of the values in a batch.

    The time is the batch's, and a repeated batch keeps its time. What no profiler
    can keep, such as temporary keys, does not enter the state.
    """
    values = field_values(
        events.observe("ingested", F.count("*").alias("events")), profiled_fields(profilers)
    )
    return (
        wanted(values, profilers)
        .withColumn("at", F.current_timestamp())
        .groupBy("field", "value")
        .agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    )


def _now(table: Table) -> DataFrame | None:
    return table() if callable(table) else table


class Analyzer:
    """What happens to each batch. See :func:`start_analyzer`."""

    def __init__(
        self,
        store: Store,
        profilers: list[Profiler],
        blocks: Table = None,
        nodes: Table = None,
        per_part: int = VALUES_PER_PART,
    ) -> None:
        self.store = store
        self.profilers = profilers
        self.blocks = blocks
        self.nodes = nodes
        self.per_part = per_part
        # Known ahead for blocks that stay the same; otherwise found per batch.
        self.lengths = prefix_lengths(blocks) if isinstance(blocks, DataFrame) else None
        self.plain = [p.name for p in profilers if p.keeps_value]
        self.derived = [p.name for p in profilers if p.kind == DEVIATION and not p.keeps_value]

    def exit_list(self, n: int) -> DataFrame | None:
        """The exit nodes as this batch finds them, kept as the batch's version of the list.

        The table ``lists`` says what was loaded, and names the fault when there is nothing: without a list
        no sighting is reported, which must not pass for a quiet day.
        """
        if self.nodes is None or not any(p.uses("is_exit") for p in self.profilers):
            return _now(self.nodes)
        store = self.store
        store.write("exit_nodes", n, _now(self.nodes).select("ip", "hi", "lo", "retrieved_at"))
        nodes = store.read("exit_nodes", n)
        fault = F.when(F.count(F.lit(1)) == 0, "missing or empty").alias("reason")
        store.write("lists", n, nodes.agg(
            F.lit("exit nodes").alias("list"), F.count(F.lit(1)).alias("entries"),
            F.max("retrieved_at").alias("retrieved_at"), fault,
        ))
        return nodes

    def judge(self, touched: DataFrame, n: int, base: int) -> DataFrame:
        """``(profiler, kind, value, is_new)`` of the batch."""
        observed = touched.select(
            "field", "value", (F.col("first_seen") == F.col("last_seen")).alias("is_new")
        )
        shown = (
            expanded(
                enriched(
                    observed, self.profilers, _now(self.blocks), self.exit_list(n), self.lengths
                ),
                self.profilers,
                "is_new",
            )
            .groupBy("profiler", "kind", "value")
            .agg(F.bool_and("is_new").alias("is_new"))
        )
        if not self.derived:
            return shown
        known = self.store.profile(n, base, self.derived).select(
            F.col("profiler").alias("_p"), F.col("value").alias("_v"), F.lit(True).alias("known")
        )
        unchanged = F.col("profiler").isin(self.plain)
        return shown.join(
            known,
            (F.col("profiler") == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v")),
            "left",
        ).select(
            "profiler",
            "kind",
            "value",
            F.when(unchanged, F.col("is_new")).otherwise(F.col("known").isNull()).alias("is_new"),
        )

    def counts(self) -> list[Column]:
        """Values shown and new values, per profiler."""
        each = {p.name: F.col("profiler") == p.name for p in self.profilers}
        return [F.count_if(c).alias(f"shown {name}") for name, c in each.items()] + [
            F.count_if(c & F.col("is_new")).alias(f"new {name}") for name, c in each.items()
        ]

    def update(self, touched: DataFrame, n: int) -> None:
        spark, store = self.store.spark, self.store
        before = store.previous_status(n)
        base = max((r.profile_base for r in before.values()), default=0)
        if n - base >= MERGE_EVERY:
            store.merge_profile(n, base)
            base = n

        # Written once, counted on the way, then read back: the stateful plan
        # runs a single time.
        seen = Observation()
        store.write("judged", n, self.judge(touched, n, base).observe(seen, *self.counts()))
        judged, counts = store.read("judged", n), seen.get
        store.write_profile(
            n,
            judged.filter((F.col("kind") == DEVIATION) & F.col("is_new")).select(
                "value", F.lit(n).cast("bigint").alias("first_batch"), "profiler"
            ),
        )

        status, alerts = [], []
        for p in self.profilers:
            old = before.get(p.name)
            size = old.profile_size if old else 0
            shown, new = counts[f"shown {p.name}"], counts[f"new {p.name}"]
            if p.kind == DEVIATION:
                sent = 1 if size and new else 0
                if sent:
                    alerts.append((p.name, DEVIATION, new, shown, size, shown - new))
                size += new
            else:
                sent = shown
                if sent:
                    alerts.append((p.name, p.kind, shown, shown, 0, 0))
            status.append(
                (
                    p.name,
                    p.field,
                    (old.alert_count if old else 0) + (1 if sent else 0),
                    (old.messages if old else 0) + sent,
                    (old.update_count if old else 0) + 1,
                    size,
                    base,
                    None,
                )
            )
        alert_rows = spark.createDataFrame(alerts, schemas.ALERTS)
        store.write("alerts", n, alert_rows)
        store.write("alert_messages", n, self.messages(judged, alert_rows, alerts, n, base))
        store.write(
            "status",
            n,
            spark.createDataFrame(status, schemas.STATUS).withColumn(
                "line", status_line(F.col("profiler"), F.col("field"), F.col("alert_count"))
            ),
        )

    def messages(
        self, judged: DataFrame, alert_rows: DataFrame, alerts: list[tuple], n: int, base: int
    ) -> DataFrame:
        names = [a[0] for a in alerts if a[1] == DEVIATION]
        here = F.lit(n).cast("bigint").alias("batch_id")
        headers = alert_rows.filter(F.col("kind") == DEVIATION).select("*", here)
        shown = judged.filter(F.col("profiler").isin(names)).select("*", here)
        held = self.store.profile(n, base, names) if names else None
        deviating = deviation_messages(headers, sections_of(shown), self.per_part, held).select(
            "profiler", F.lit(DEVIATION).alias("kind"), F.lit(None).cast("string").alias("address"),
            "part", "parts", "subject", "body",
        )
        sighted = sighting_messages(
            judged.filter(F.col("kind") == SIGHTING).select("profiler", here, "value")
        ).select(
            "profiler", F.lit(SIGHTING).alias("kind"), "address",
            F.lit(1).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("parts"),
            "subject", "body",
        )
        return deviating.unionByName(sighted)


def start_analyzer(
    spark: SparkSession,
    events: DataFrame,
    store: str,
    checkpoint: str,
    profilers: list[Profiler] | None = None,
    blocks: Table = None,
    nodes: Table = None,
    trigger: dict | None = None,
    values_per_part: int = VALUES_PER_PART,
) -> StreamingQuery:
    """Profiles a stream of ``event_json`` and writes profiles, alerts and status.

    ``blocks`` and ``nodes`` are the geo blocks and exit nodes, or functions that
    load them, called for every batch; each batch keeps its version of the nodes and tells in the table ``lists`` whether
    there were any. ``store`` and ``checkpoint`` belong
    together: keep both to resume, change both to start afresh. An alert text with
    more than ``values_per_part`` values in a list goes on in further parts. The number of
    ingested events is in the progress of the query, metric ``ingested``.
    """
    if spark.conf.get(STATE_PROVIDER, "").endswith("HDFSBackedStateStoreProvider"):
        # State on disk: profiles outgrow memory.
        spark.conf.set(STATE_PROVIDER, ROCKSDB_PROVIDER)
    analyzer = Analyzer(
        Store(spark, store), profilers or DEFAULT_PROFILERS, blocks, nodes, values_per_part
    )
    return (
        touched_values(events, analyzer.profilers)
        .writeStream.outputMode("update")
        .foreachBatch(analyzer.update)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
