import gzip
import json
import os
import shutil

import pytest
from frames import rows
from pyspark.sql import functions as F

from vigilog.operators import alerts, profiles
from vigilog.operators import profilers as P
from vigilog.operators.geo import blocks_from_ranges
from vigilog.sources.exit_nodes import exit_nodes
from vigilog.streaming import analyzer as analyzer_module
from vigilog.streaming.analyzer import Analyzer, start_analyzer
from vigilog.streaming.inputs import both_inputs, replay_events, staged_events, start_notification_ingest
from vigilog.streaming.store import Store

NOW = {"availableNow": True}
PROFILERS = [*P.DEFAULT_PROFILERS, P.SOURCE_IP_PROFILER]


def event(ip, key, arn):
    return {"sourceIPAddress": ip, "userIdentity": {"accessKeyId": key, "arn": arn}}


BATCHES = [
    [event("10.0.0.1", "AKIA1", "a"), event("10.0.0.2", "ASIA1", "b")],
    [event("10.0.0.1", "AKIA2", "a")],
    [event("11.0.0.1", "ASIA2", "c"), event("host", "ASIA3", "a")],
    [event("10.0.0.2", "AKIA1", "b")],
]


def put(folder, name, events):
    folder.mkdir(parents=True, exist_ok=True)
    text = json.dumps({"Records": events})
    (folder / f"{name}.json.gz").write_bytes(gzip.compress(text.encode()))


@pytest.fixture(scope="module")
def lookups(spark):
    ranges = spark.createDataFrame(
        [(10 << 24, (11 << 24) - 1, None, "X")], "lo long, hi long, city string, country string"
    )
    nodes = exit_nodes(spark.createDataFrame([("ExitAddress 10.0.0.2 x",)], "value string"))
    return blocks_from_ranges(ranges), nodes


def run(spark, folder, lookups, events=None):
    query = start_analyzer(
        spark,
        events if events is not None else replay_events(spark, f"{folder}/in"),
        f"{folder}/store",
        f"{folder}/checkpoint",
        PROFILERS,
        blocks=lookups[0],
        nodes=lambda: lookups[1],
        trigger=NOW,
    )
    query.awaitTermination()
    return query


def replay_all(spark, folder, lookups):
    for n, events in enumerate(BATCHES):
        put(folder / "in", f"o{n}", events)
        query = run(spark, folder, lookups)
        assert query.recentProgress[-1].observedMetrics["ingested"].events == len(events)
    return Store(spark, f"{folder}/store")


@pytest.fixture(scope="module")
def stream(spark, lookups, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    return folder, replay_all(spark, folder, lookups)


@pytest.fixture(scope="module")
def batch(spark, lookups):
    events = spark.createDataFrame(
        [(n, json.dumps(e)) for n, events in enumerate(BATCHES) for e in events],
        "batch_id long, event_json string",
    )
    observed = P.observations(events, P.profiled_fields(PROFILERS))
    return events, P.candidates(observed, PROFILERS, *lookups)


def test_stream_equals_batch(spark, stream, batch):
    _, store = stream
    events, seen = batch
    columns = ["profiler", "batch_id", "n_new", "n_current", "n_profile", "n_intersection"]
    streamed = store.output("alerts").filter("kind = 'deviation'").select(columns)
    found = profiles.deviations(seen)
    assert rows(streamed) == rows(found.select(columns)) and streamed.count() > 3
    bodies = alerts.deviation_messages(
        found,
        profiles.alert_values(seen, found).unionByName(profiles.profile_lists(profiles.first_seen(seen), found)),
    )
    messages = store.output("alert_messages")
    assert rows(messages.filter("kind = 'deviation'").select("profiler", "batch_id", "subject", "body")) == rows(
        bodies.select("profiler", "batch_id", "subject", "body")
    )
    assert rows(messages.filter("kind = 'tor'").select("batch_id", "address", "body")) == [
        (n, "10.0.0.2", "Activity on your AWS resources has been seen from 10.0.0.2 which is a Tor exit node.")
        for n in (0, 3)
    ]
    columns = ["batch_id", "profiler", "field", "alert_count", "messages", "update_count", "line"]
    assert rows(store.output("status").select(columns)) == rows(
        profiles.profile_status(events.select("batch_id"), profiles.increments(seen), PROFILERS).select(columns)
    )
    assert rows(store.profile(4)) == rows(
        profiles.first_seen(seen).select("value", "first_batch", "profiler")
    )


def test_repeated_batch_changes_nothing(spark, stream, lookups):
    """Drop the commit of the last batch: the stream runs it again."""
    folder, _ = stream
    again = folder.parent / "again"
    shutil.copytree(folder, again)
    store = Store(spark, f"{again}/store")
    before = {t: rows(store.output(t)) for t in ("judged", "alerts", "alert_messages", "status")}
    for name in ("3", ".3.crc"):
        if os.path.exists(again / "checkpoint" / "commits" / name):
            os.unlink(again / "checkpoint" / "commits" / name)
    shutil.copytree(again / "in", again / "kept")
    query = run(spark, folder, lookups, replay_events(spark, f"{folder}/in"))
    assert not [p for p in query.recentProgress if p.numInputRows]
    spark.read.text(str(again / "kept")).count()
    query = start_analyzer(
        spark, replay_events(spark, f"{folder}/in"), f"{again}/store", f"{again}/checkpoint",
        PROFILERS, *lookups, trigger=NOW,
    )
    query.awaitTermination()
    assert [p.batchId for p in query.recentProgress][0] == 3
    assert before == {t: rows(Store(spark, f"{again}/store").output(t)) for t in before}


def test_store_must_match_its_checkpoint(spark, stream, tmp_path):
    folder, store = stream
    with pytest.raises(RuntimeError):
        store.previous_status(0)
    with pytest.raises(RuntimeError):
        Store(spark, f"{tmp_path}/empty").previous_status(5)
    assert Store(spark, f"{tmp_path}/empty").previous_status(0) == {}


def test_merged_profiles_give_the_same_alerts(spark, stream, lookups, tmp_path, monkeypatch):
    monkeypatch.setattr(analyzer_module, "MERGE_EVERY", 2)
    store = replay_all(spark, tmp_path, lookups)
    assert os.path.isdir(tmp_path / "store" / "merged" / "upto=2")
    for table in ("alerts", "alert_messages"):
        assert rows(store.output(table)) == rows(stream[1].output(table))
    assert rows(store.profile(4, base=2)) == rows(stream[1].profile(4))


def test_notifications_to_staged_events(spark, lookups, tmp_path):
    put(tmp_path / "bucket" / "logs", "one", BATCHES[0])
    put(tmp_path / "bucket" / "logs", "two", BATCHES[1])
    put(tmp_path / "old", "zero", BATCHES[2])
    (tmp_path / "bucket" / "logs" / "cut.json.gz").write_bytes(gzip.compress(b"x" * 9000)[:20])

    def notify(name, bucket, *keys):
        message = json.dumps({"s3Bucket": bucket, "s3ObjectKey": list(keys)})
        folder = tmp_path / "bodies"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(json.dumps({"Type": "Notification", "Message": message}, indent=1))

    notify("n1", "bucket", "logs/one.json.gz", "logs/gone.json.gz")
    notify("n2", "bucket", "logs/two.json.gz", "logs/two.json.gz", "logs/cut.json.gz")
    notify("n3", "nobucket", "x.json.gz")
    (tmp_path / "bodies" / "n4").write_text("{}")
    start_notification_ingest(
        spark, f"{tmp_path}/bodies", f"{tmp_path}/{{bucket}}/{{key}}", f"{tmp_path}/staged",
        f"{tmp_path}/ingest", whole_files=True, trigger=NOW,
    ).awaitTermination()
    rejects = spark.read.parquet(f"{tmp_path}/staged/rejects")
    assert sorted(r.line.rsplit("/", 1)[-1] for r in rejects.filter("source = 'object'").collect()) == [
        "cut.json.gz", "gone.json.gz", "x.json.gz"
    ]
    assert rejects.filter("source = 'notification'").count() == 1
    events = both_inputs(
        replay_events(spark, f"{tmp_path}/old"), staged_events(spark, f"{tmp_path}/staged")
    )
    run(spark, tmp_path, lookups, events)
    store = Store(spark, f"{tmp_path}/store")
    assert rows(store.output("judged").filter("profiler = 'arn'").select("value")) == [("a",), ("b",), ("c",)]
    assert store.output("alerts").filter(F.col("kind") == P.DEVIATION).count() == 0


def test_analyzer_counts_are_per_profiler(spark, tmp_path):
    made = Analyzer(Store(spark, str(tmp_path)), PROFILERS)
    assert len(made.counts()) == 2 * len(PROFILERS)
    assert made.derived == [P.CITY_PROFILER, P.COUNTRY_PROFILER]


def test_a_listed_address_is_new_on_the_day_it_is_listed(spark, lookups, tmp_path):
    """The state knows the address from the first batch; the profile does not."""
    listed_exit = P.Profiler("Exits", P.SOURCE_IP_ADDRESS, keep="is_exit")
    lists = iter([["10.0.0.9"], ["10.0.0.9", "10.0.0.1"], ["10.0.0.9", "10.0.0.1"]])

    def nodes():
        lines = [(f"ExitAddress {ip} x",) for ip in next(lists)]
        return exit_nodes(spark.createDataFrame(lines, "value string"))

    analyzer_store = f"{tmp_path}/store"
    for n in range(3):
        put(tmp_path / "in", f"o{n}", [event("10.0.0.1", "ASIA1", "a"), event("10.0.0.9", "AKIA1", "a")])
        start_analyzer(
            spark, replay_events(spark, f"{tmp_path}/in"), analyzer_store, f"{tmp_path}/checkpoint",
            [listed_exit, P.ACCESS_KEY_PROFILER], nodes=nodes, trigger=NOW,
        ).awaitTermination()
    store = Store(spark, analyzer_store)
    found = store.output("alerts").filter("profiler = 'Exits'").select("batch_id", "n_new", "n_profile")
    assert rows(found) == [(1, 1, 1)]
    state = spark.read.format("statestore").load(f"{tmp_path}/checkpoint")
    kept = {r.value for r in state.select("key.value").collect()}
    assert kept == {"10.0.0.1", "10.0.0.9", "AKIA1"}  # no temporary key
