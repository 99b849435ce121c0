"""Expiry by session windows, against the rule in plain Python; arrivals of many objects, made once."""

import json
import random

from frames import rows
from pyspark.sql import functions as F

from vigilog.operators import profilers as P
from vigilog.plans.queries import QUERIES
from vigilog.streaming import replay
from vigilog.streaming.expiry import EXPIRED, _lived, expired_stream

NOW = {"availableNow": True}


class Life:
    """What Spark's state of one value holds, for the rule in plain Python."""

    def __init__(self):
        self.value, self.hasTimedOut = None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        pass

    def getCurrentWatermarkMs(self):
        return 0


def test_expired_sessions_against_the_rule(spark, tmp_path, capsys):
    import pandas as pd

    ttl, rng, wanted = 100, random.Random(4), []
    shown = {v: sorted(rng.choice([1, 50, 99, 100, 101, 102]) + 200 * rng.randrange(1, 40) for _ in range(25)) for v in "abcdef"}
    shown["edge"] = [1000, 1100, 1201]  # a life goes on at ttl and ends beyond it
    events = [(json.dumps({"principalId": v}), ms) for v, times in shown.items() for ms in times]
    events += [("not json", 5000), (None, 5000), (json.dumps({"principalId": None}), 20000), (json.dumps({"principalId": "z"}), None)]
    frame = spark.createDataFrame(events, "event_json string, ms long").withColumn("at", F.timestamp_millis("ms"))
    frame = frame.withColumn("at", F.expr("at + interval 300 microseconds"))  # parts of milliseconds do not count
    frame.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    found = expired_stream(stream, [P.PRINCIPAL_PROFILER], ttl, "1 millisecond")
    found.explain()
    assert "FlatMapGroupsInPandasWithState" not in capsys.readouterr().out  # no Python call per value and batch
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(**NOW)
    query.start(f"{tmp_path}/out").awaitTermination()
    for value, times in shown.items():
        state = Life()
        frames = iter([pd.DataFrame({"at": pd.to_datetime(times, unit="ms")})])
        ends = [t for f in _lived(ttl, ("principalId", value), frames, state) for t in f["last_seen"]]
        wanted += [("principalId", value, t) for t in [*ends, state.get[0]]]
    got = sorted(rows(spark.read.schema(EXPIRED).parquet(f"{tmp_path}/out")))
    assert got == sorted(wanted)


def test_an_arrival_of_many_objects_is_one_batch(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "run_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    # Adaptive execution would make one small object of each arrival.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(QUERIES["stream_ingested_counts"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert [b for b, _ in got] == list(range(6)) and sum(n for _, n in got) == events.count()
    objects = list(tmp_path.glob("ingested/objects/**/*.json.gz"))
    assert len(objects) > 6  # the tasks write and read an arrival together


def test_the_replay_makes_its_events_once(spark, sf_dir, monkeypatch):
    class Ended:
        def awaitTermination(self):
            pass

    purposes = []

    def staged(frame, purpose):
        purposes.append(purpose)
        return frame.limit(1000)

    monkeypatch.setattr(replay, "staged", staged)
    monkeypatch.setattr(replay, "start_analyzer", lambda *given, **named: Ended())
    replay.replayed(spark, sf_dir)
    assert purposes == ["arrivals", "blocks", "nodes"]
