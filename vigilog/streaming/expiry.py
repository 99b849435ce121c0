"""Profile values that expire, as a stream: session windows over event time.

A life of a (field, value) is a session: it lasts as long as no two sightings are further apart than the time to live. When the
watermark has passed the last sighting by more than that, the life is reported as expired and its state is removed, so the state
holds only lives that may go on. It is the streaming form of ``operators.expiry.expired_values``, with event time in place of
batch numbers. Spark sorts, merges and stores the sessions; a hot value is folded by time before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from vigilog.operators.profilers import Profiler, expanded, field_values, profiled_fields
from vigilog.session import ROCKSDB_PROVIDER
from vigilog.streaming.analyzer import STATE_PROVIDER

EXPIRED = "profiler string, value string, last_seen bigint"


def _lived(ttl_ms: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rule for one value in plain Python, which the session windows are tested against.

    Gives the ends of the value's lives that a batch shows, or the one that the watermark shows.
    """
    last, ends = (state.get[0] if state.exists else None), []
    if state.hasTimedOut:
        ends.append(last)
        state.remove()
    else:
        times = sorted({int(t.value) // 1_000_000 for frame in frames for t in frame["at"]})
        for now in times:
            if last is not None and now - last > ttl_ms:
                ends.append(last)
            last = now if last is None else max(last, now)
        state.update((last,))
        # A watermark that has come further would refuse the time; then the next one ends this life.
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
    if ends:
        yield pd.DataFrame({"profiler": key[0], "value": key[1], "last_seen": ends})


def expired_stream(
    events: DataFrame, profilers: list[Profiler], ttl_ms: int, delay: str = "10 minutes"
) -> DataFrame:
    """Streaming ``EXPIRED`` rows: values unseen for more than ``ttl_ms``, with the time in ms of their last sighting.

    ``events`` need ``event_json`` and the event time ``at``, which counts in whole milliseconds; without one an event does
    not count. The watermark is ``delay`` behind the latest event. An event that comes behind it prolongs a life that is not
    reported yet; one so late that the life it would begin has expired does not count. Only profilers whose values need no
    lookup can be given.
    """
    if any(p.needs_lookup for p in profilers):
        raise ValueError("values that a lookup decides have no keyed state")
    spark = events.sparkSession
    if spark.conf.get(STATE_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_PROVIDER, ROCKSDB_PROVIDER)
    values = field_values(events, profiled_fields(profilers), "at")
    shown = expanded(values, profilers, "at").filter("value is not null").select(
        "profiler", "value", F.date_trunc("millisecond", "at").alias("at")
    )
    # Sessions part at more than their gap, and end once the watermark, in milliseconds, has reached their end.
    life = F.session_window("at", f"{ttl_ms * 1000 + 999} microseconds")
    return (
        shown.withWatermark("at", delay)
        .groupBy("profiler", "value", life.alias("life"))
        .agg(F.max("at").alias("last"))
        .select("profiler", "value", F.unix_millis("last").alias("last_seen"))
    )
