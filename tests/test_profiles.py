import json
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from vigilog.functions.deep_json import _number_text, find_values
from vigilog.operators import alerts, profiles
from vigilog.operators import profilers as P
from vigilog.operators.geo import blocks_from_ranges
from vigilog.sources.exit_nodes import exit_nodes

SEEN = "profiler string, kind string, batch_id long, value string"

DEEP = {
    '{"arn":"a"}': {("arn", "a")},
    '{"x":{"arn":"b","y":[{"arn":"c"},{"arn":"b"}]}}': {("arn", "b"), ("arn", "c")},
    '{"arn":null}': {("arn", "null")},
    '{"arn":12,"k":{"arn":true}}': {("arn", "12"), ("arn", "true")},
    '{"arn":{"arn":"inner","accessKeyId":"in"},"z":{"arn":"q"}}': {
        ("arn", ""), ("arn", "q"), ("accessKeyId", "in")
    },
    '{"s":"{\\"arn\\":\\"no\\"}","ARN":"no","l":["arn"]}': set(),
    '{"arn":"a\\"b","accessKeyId":["x"]}': {("arn", 'a"b'), ("accessKeyId", "")},
    '{"\\u0061rn":"esc"}': {("arn", "esc")},
    '{"arn":1.50,"a":[{"arn":1e10}]}': {("arn", "1.5"), ("arn", "1.0E10")},
    '{"arn":"x","arn":"y"}': {("arn", "y")},
    '[[{"arn":"r"}]]': {("arn", "r")},
    '{"arn":12345678901234567890123}': {("arn", "12345678901234567890123")},
    "{}": set(),
    "not json": set(),
    '{"arn":NaN}': set(),
    "": set(),
}


def test_deep_values(spark):
    events = spark.createDataFrame([(t,) for t in DEEP] + [(None,)], "event_json string")
    found = {t: set() for t in DEEP}
    for r in P.field_values(events.withColumn("t", F.col("event_json")), ["arn", "accessKeyId"], "t").collect():
        found[r.t].add((r.field, r.value))
    assert found == DEEP


def test_deep_values_run_once(spark):
    events = spark.createDataFrame([('{"arn":"a"}',)], "event_json string")
    plan = P.field_values(events, ["arn"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_number_text_and_depth():
    cases = [(1e7, "1.0E7"), (1e-3, "0.001"), (9.99e-4, "9.99E-4"), (123456.75, "123456.75"),
             (-2.5e-7, "-2.5E-7"), (0.0, "0.0"), (-0.0, "-0.0"), (float("inf"), "Infinity"), (100.0, "100.0")]
    assert [_number_text(v) for v, _ in cases] == [t for _, t in cases]
    assert find_values("[" * 100_000 + "]" * 100_000, frozenset(["arn"])) in (None, [])


# --- a direct model of the state machine ---------------------------------------


def model(history):
    """Profile, alerts and counts after each batch, from sets kept in memory."""
    profile, count, alerts_sent = set(), 0, []
    for batch, values in history:
        if not profile:
            profile = set(values)
        elif not values <= profile:
            alerts_sent.append((batch, values - profile, set(values), set(profile), values & profile))
            profile |= values
            count += 1
    return profile, alerts_sent


def random_histories(seed):
    rng = random.Random(seed)
    for name in ("p1", "p2", "p3"):
        pool = [None, *"abcdefghijkl"]
        yield name, [
            (b, set(rng.sample(pool, rng.choice([0, 0, 1, 2, 4])))) for b in range(rng.randint(1, 25))
        ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_form_agrees_with_the_state_machine(spark, seed):
    histories = dict(random_histories(seed))
    seen = spark.createDataFrame(
        [(n, P.DEVIATION, b, v) for n, h in histories.items() for b, vs in h for v in vs], SEEN
    )
    found = profiles.deviations(seen)
    bodies = alerts.deviation_messages(
        found,
        profiles.alert_values(seen, found).unionByName(profiles.profile_lists(profiles.first_seen(seen), found)),
    )
    texts = {(r.profiler, r.batch_id): r for r in bodies.collect()}
    expected, final = [], []
    for name, history in histories.items():
        profile, sent = model(history)
        final += [(name, v) for v in profile]
        for batch, new, current, before, both in sent:
            expected.append((name, batch, len(new), len(current), len(before), len(both)))

            def shown(values):
                return ",".join(sorted("null" if v is None else v for v in values))

            message = texts[name, batch]
            assert message.subject == f"CloudTrail Profile Mismatch for {name}"
            assert message.body == (
                f"New activity which doesn't fit current profile: {shown(new)}\r\n"
                f"\r\nCurrent activity (including compliant activity): {shown(current)}\r\n"
                f"Current profile (which was not matched): {shown(before)}\r\n"
                "The following is the intersection between the existing profile and new activity: "
                f"{shown(both)}\r\n\r\nThe profile will be updated (to avoid duplicate alarms)"
            )
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert len(texts) == len(expected)
    assert rows(profiles.first_seen(seen).select("profiler", "value")) == rows(
        spark.createDataFrame(final, "profiler string, value string")
    )


def test_long_lists_split_into_parts_and_stay_whole(spark):
    values = [f"v{i}" for i in range(100)]
    seen = spark.createDataFrame(
        [("p", P.DEVIATION, 0, "base")] + [("p", P.DEVIATION, 1, v) for v in values], SEEN
    )
    lists = alerts.listed(profiles.new_values(seen), "profiler", "batch_id", per_part=10).collect()
    assert len(lists) > 1 and {r.parts for r in lists} == {10}
    assert sorted(v for r in lists for v in r["values"]) == sorted(values)
    found = profiles.deviations(seen)
    messages = alerts.deviation_messages(found, profiles.alert_values(seen, found), per_part=10)
    assert sorted((r.part, r.parts) for r in messages.collect()) == [(i, 10) for i in range(1, 11)]
    listed = [
        v
        for r in messages.collect()
        for v in r.body.split("\r\n")[0].removeprefix(alerts.NEW_LABEL).split(",")
        if v
    ]
    assert sorted(listed) == sorted(values)


def test_running_totals_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(profiles, "BLOCK", 3)
    frame = spark.createDataFrame([(k, b, b % 4) for k in "xy" for b in range(0, 40, 2)], "k string, b long, n long")
    totals = profiles.running_totals(frame, "k", "b", {"n": "t"})
    for r in totals.collect():
        assert r.t == sum(b % 4 for b in range(0, r.b + 1, 2))


def test_status_counts_batches_without_activity(spark):
    seen = spark.createDataFrame(
        [("arn", P.DEVIATION, 0, "a"), ("arn", P.DEVIATION, 2, "b"), (P.EXIT_PROFILER, P.SIGHTING, 2, "1.1.1.1"),
         (P.EXIT_PROFILER, P.SIGHTING, 2, "2.2.2.2")],
        SEEN,
    )
    status = profiles.profile_status(
        spark.range(4).select(F.col("id").alias("batch_id")),
        profiles.increments(seen),
        [P.ARN_PROFILER, P.TOR_PROFILER],
    )
    got = {(r.profiler, r.batch_id): (r.alert_count, r.messages, r.update_count) for r in status.collect()}
    assert got == {
        ("arn", 0): (0, 0, 1), ("arn", 1): (0, 0, 2), ("arn", 2): (1, 1, 3), ("arn", 3): (1, 1, 4),
        (P.EXIT_PROFILER, 0): (0, 0, 1), (P.EXIT_PROFILER, 1): (0, 0, 2),
        (P.EXIT_PROFILER, 2): (1, 2, 3), (P.EXIT_PROFILER, 3): (1, 2, 4),
    }
    line = status.filter("profiler = 'arn' and batch_id = 3").first().line
    assert line == "The arn profiler for the field arn has issued 1 alerts."


def test_profilers_filter_look_up_and_extend(spark):
    def event(ip, key, arn="r"):
        return json.dumps({"sourceIPAddress": ip, "userIdentity": {"accessKeyId": key, "arn": arn}})

    events = spark.createDataFrame(
        [(0, event("10.0.0.1", "ASIA1")), (0, event("10.0.0.2", "AKIA1")), (0, event("host", "AKIA1")),
         (1, event("11.0.0.1", "ASIA2")), (1, "")],
        "batch_id long, event_json string",
    )
    blocks = blocks_from_ranges(
        spark.createDataFrame([(10 << 24, (11 << 24) - 1, None, "X")], "lo long, hi long, city string, country string")
    )
    nodes = exit_nodes(spark.createDataFrame([("ExitAddress 10.0.0.2 x",)], "value string"))

    def add_length(observed):
        return observed.withColumn("length", F.length("value"))

    custom = P.Profiler("Long-Keys", P.ACCESS_KEY_ID, "length", "length > 4", enrich=add_length)
    chosen = [*P.DEFAULT_PROFILERS, custom]
    seen = P.candidates(P.observations(events, P.profiled_fields(chosen)), chosen, blocks, nodes)
    assert rows(seen.select("profiler", "batch_id", "value")) == rows(
        spark.createDataFrame(
            [("accessKeyId", 0, "AKIA1"), ("arn", 0, "r"), ("arn", 1, "r"),
             ("SourceIP-City", 0, None), ("SourceIP-City", 0, "Unknown"), ("SourceIP-City", 1, "Unknown"),
             ("SourceIP-Country", 0, "X"), ("SourceIP-Country", 0, "Unknown"), ("SourceIP-Country", 1, "Unknown"),
             ("SourceIP-TorExitNode", 0, "10.0.0.2"), ("Long-Keys", 0, "5"), ("Long-Keys", 1, "5")],
            "profiler string, batch_id long, value string",
        )
    )
    assert not custom.keeps_value and P.ACCESS_KEY_PROFILER.keeps_value
    with pytest.raises(ValueError):
        P.enriched(P.observations(events, ["sourceIPAddress"]), chosen)


def test_a_hot_value_is_folded_before_it_is_joined(spark):
    """A third of all rows are one value: what reaches the join is one row per batch."""
    hot = spark.range(30_000).select(
        (F.col("id") % 20).alias("batch_id"),
        F.lit("sourceIPAddress").alias("field"),
        F.when(F.col("id") % 3 == 0, F.lit("9.9.9.9")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("value"),
    )
    seen = P.candidates(hot.distinct(), [P.SOURCE_IP_PROFILER])
    assert seen.filter("value = '9.9.9.9'").count() == 20
    assert profiles.first_seen(seen).count() == 20_001
    assert profiles.deviations(seen).agg(F.sum("n_new")).first()[0] == 20_001 - seen.filter("batch_id = 0").count()
