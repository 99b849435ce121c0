"""Profiles that expire, exit nodes by actor and root use: against plain versions, on odd rows."""

import json
import random

import pandas as pd
import pytest
from frames import rows

from vigilog.operators import actors, expiry, profiles
from vigilog.operators import profilers as P
from vigilog.sources.exit_nodes import exit_nodes
from vigilog.streaming.expiry import _lived, expired_stream

SEEN = "profiler string, kind string, batch_id long, value string"


def plain(seen, ttl):
    """Walks the batches, one value at a time."""
    end = max((b for _, k, b, _ in seen if k == P.DEVIATION), default=0)
    shown = {}
    for profiler, kind, batch, value in seen:
        if kind == P.DEVIATION:
            shown.setdefault((profiler, value), set()).add(batch)
    expired, counts = [], {}
    for (profiler, value), batches in shown.items():
        last = None
        for b in sorted(batches):
            away = 0 if last is None else b - last - 1
            n = counts.setdefault((profiler, b), [0, 0, 0])
            n[0] += 1
            n[1] += last is None
            n[2] += away > ttl
            if away > ttl:
                expired.append((profiler, value, last, last + ttl + 2, b))
            last = b
        if end - last - 1 > ttl:
            expired.append((profiler, value, last, last + ttl + 2, None))
    base = {p: min(b for q, b in counts if q == p) for p, _ in counts}
    counted = [(p, b, *n, n[1] + n[2] > 0 and b > base[p]) for (p, b), n in counts.items()]
    order = lambda r: [(v is None, str(v)) for v in r]
    return sorted(expired, key=order), sorted(counted, key=order)


@pytest.mark.parametrize("ttl", [0, 2, 9])
@pytest.mark.parametrize("block", [1, 3, 4096])
def test_expiry_against_a_walk(spark, monkeypatch, ttl, block):
    monkeypatch.setattr(expiry, "BLOCK", block)
    rng = random.Random(ttl)
    seen = {
        (rng.choice("pq"), rng.choice([P.DEVIATION] * 4 + [P.SIGHTING]), rng.randrange(40), rng.choice(["a", "b", "c", None]))
        for _ in range(60)
    }
    frame = spark.createDataFrame(sorted(seen, key=str), SEEN)
    expired, counted = plain(seen, ttl)
    assert rows(expiry.expired_values(frame, ttl)) == expired
    columns = ["profiler", "batch_id", "n_current", "n_new", "n_returned", "alerts"]
    assert rows(expiry.expiring_counts(frame, ttl).select(columns)) == counted


def test_profiles_without_observations_or_expiry(spark):
    nothing = spark.createDataFrame([], SEEN)
    assert rows(expiry.expired_values(nothing, 1)) == [] and rows(expiry.expiring_counts(nothing, 1)) == []
    frame = spark.createDataFrame([("p", P.DEVIATION, b, v) for b, v in [(0, "a"), (50, "a"), (50, "b")]], SEEN)
    # With a long life, only what was never seen before alerts, like in profiles that never expire.
    new = {(r["profiler"], r["batch_id"]) for r in expiry.expiring_counts(frame, 1000).filter("alerts").collect()}
    assert new == {(r["profiler"], r["batch_id"]) for r in profiles.new_values(frame).collect()}


class State:
    """Holds what Spark's state of one key holds."""

    def __init__(self):
        self.value, self.hasTimedOut, self.at, self.watermark = None, False, None, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.at = at

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_one_key_of_the_stream():
    state = State()

    def shown(*ms):
        frames = [pd.DataFrame({"at": pd.to_datetime([m], unit="ms")}) for m in ms]
        return [list(f["last_seen"]) for f in _lived(100, ("p", "v"), iter(frames), state)]

    assert shown(5, 50) == [] and state.value == (50,) and state.at == 150
    assert shown(151, 40) == [[50]]
    assert state.value == (151,)
    state.watermark = 400  # late rows are dropped before, so a time may still be behind
    assert shown(401) == [[151]] and state.at == 501
    state.hasTimedOut = True
    assert shown() == [[401]] and not state.exists


def test_lookups_have_no_keyed_state(spark):
    events = spark.createDataFrame([], "event_json string, at timestamp")
    with pytest.raises(ValueError):
        expired_stream(events, [P.GEO_CITY_PROFILER], 1)


def event(**members):
    return json.dumps(members)


EVENTS = [
    (3, event(userIdentity={"principalId": "A"}, sourceIPAddress="1.2.3.4")),
    (1, event(userIdentity={"principalId": "A"}, sourceIPAddress="1.2.3.4")),
    (2, event(userIdentity={"principalId": "B"}, sourceIPAddress="1.2.3.4")),
    (2, event(userIdentity={"principalId": "B"}, sourceIPAddress="9.9.9.9")),
    (4, event(sourceIPAddress="1.2.3.4")),
    (4, event(list=[{"principalId": "C"}, {"principalId": "D"}], sourceIPAddress="1.2.3.4")),
    (5, event(userIdentity={"principalId": "E"})),
    (5, "not json"),
    (5, None),
]


def test_exit_nodes_once_per_actor(spark):
    lines = spark.createDataFrame([("ExitAddress 1.2.3.4 2015-10-08 13:06:31",)], "value string")
    events = spark.createDataFrame(EVENTS, "batch_id long, event_json string")
    found = actors.sighted_actors(events, exit_nodes(lines))
    assert rows(found) == [(1, "A", "1.2.3.4"), (2, "B", "1.2.3.4"), (4, "C", "1.2.3.4"), (4, "D", "1.2.3.4"), (4, None, "1.2.3.4")]
    assert rows(actors.sighted_actors(events, exit_nodes(lines.limit(0)))) == []


def test_root_use(spark):
    identity = {"principalId": "1", "accountId": "1"}
    events = [
        event(eventID="a", eventName="n", eventSource="s", userIdentity=identity),
        event(eventID="b", userIdentity={"principalId": "2", "accountId": "1"}),
        event(eventID="c", userIdentity={"principalId": None, "accountId": None}),
        event(eventID="d"),
        "not json",
        None,
    ]
    frame = spark.createDataFrame([(e, 1) for e in events], "event_json string, event_id int")
    assert rows(actors.root_uses(frame)) == [("a", "s", "n", "1")]
