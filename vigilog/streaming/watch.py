"""Alerts on single events as streams: exit nodes once per actor, and use of the root account.

Both write a folder per batch, which a retry overwrites.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.functions.addresses import with_address
from vigilog.operators.actors import actor_addresses, root_uses
from vigilog.operators.exits import with_flags
from vigilog.session import ROCKSDB_PROVIDER
from vigilog.streaming.analyzer import STATE_PROVIDER

SIGHTED = "actor string, address string, batch_id bigint"
ROOT_USES = "event_id string, event_source string, event_name string, account string, batch_id bigint"


def _write(folder: str, rows: DataFrame, n: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={n}")


def _first(folder: str, rows: DataFrame, n: int) -> None:
    _write(folder, rows.filter("first_seen = last_seen").select("actor", "address"), n)


def start_actor_watch(
    events: DataFrame, nodes: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Writes ``SIGHTED`` rows: exit nodes in use, each once per actor.

    Only pairs on the list enter the keyed state, so an address that is listed later is reported with the next event
    that comes from it. A repeated batch keeps its time and so finds the same pairs new.
    """
    spark = events.sparkSession
    if spark.conf.get(STATE_PROVIDER, "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_PROVIDER, ROCKSDB_PROVIDER)
    pairs = with_address(actor_addresses(events), "address")
    listed = with_flags(pairs, nodes).filter("is_exit").withColumn("at", F.current_timestamp())
    state = listed.groupBy("actor", "address").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return (
        state.writeStream.outputMode("update")
        .foreachBatch(partial(_first, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def start_root_watch(
    events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Writes ``ROOT_USES`` rows: every event of a root account. Keeps no state."""
    return (
        root_uses(events)
        .writeStream.foreachBatch(partial(_write, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def watched(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a watch has written so far."""
    return spark.read.schema(schema).parquet(folder)
