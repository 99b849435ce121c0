"""The object reader, events as VARIANT, and SQL functions over known addresses."""

import gzip
import io
import os
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from vigilog.operators import alerts, profiles
from vigilog.operators import profilers as P
from vigilog.operators.geo import blocks_from_networks, register_geo_functions
from vigilog.sources import access, audit
from vigilog.sources.objects import lines_of, object_lines, object_rejects, read_objects
from vigilog.streaming.inputs import replayed_objects

NOW = {"availableNow": True}


def opener(contents):
    def opened(path):
        if path not in contents:
            raise FileNotFoundError(path)
        return io.BytesIO(contents[path])

    return opened


TWO = gzip.compress(b"one\ntwo\n") + gzip.compress(b"three\r\nfour\rfive")


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (TWO, [("one", None), ("two", None), ("three", None), ("four", None), ("five", None)]),
        (TWO[:-3], [("one", None), ("two", None), ("three", None), ("four", None), (None, "cut after 4 lines")]),
        (gzip.compress(b"one\n") + TWO[:5], [("one", None), (None, "cut after 1 lines")]),
        (b"", [(None, "empty")]),
        (gzip.compress(b""), [(None, "empty")]),
        (b"plain\n", [(None, "not gzip")]),
        (gzip.compress(b"one\n") + b"trailing", [("one", None), (None, "damaged gzip after 1 lines")]),
        (gzip.compress("é\n".encode() + b"\xff\n"), [("é", None), ("�", None)]),
        (gzip.compress(b"\n\n"), [("", None), ("", None)]),
    ],
)
def test_lines_and_faults_of_an_object(content, want):
    assert list(lines_of("a.gz", opener({"a.gz": content}))) == want


def test_plain_objects_and_line_ends_across_reads(monkeypatch):
    import vigilog.sources.objects as objects

    monkeypatch.setattr(objects, "READ_BYTES", 3)
    assert [x for x, _ in lines_of("a", opener({"a": b"ab\r\ncd\r\r\nef"}))] == ["ab", "cd", "", "ef"]
    long = gzip.compress(b"x" * 100_000 + b"\n" + b"y" * 100_000)
    assert [len(x) for x, _ in lines_of("a.gz", opener({"a.gz": long}))] == [100_000, 100_000]


def test_objects_are_read_where_the_names_are(spark, tmp_path):
    (tmp_path / "a b%20+ü.gz").write_bytes(gzip.compress(b'{"Records":[{"id":1},{"id":2}]}\n'))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b'{"Records":[{"id":3}]}\n') + TWO[:9])
    (tmp_path / "none.gz").write_bytes(b"")
    names = ["a b%20+ü.gz", "cut.gz", "none.gz", "gone.gz"]
    paths = [(f"{tmp_path}/{n}",) for n in names] + [(f"file:{tmp_path}/cut.gz",), (None,), ("nfs4://x/y",)]
    read = read_objects(spark.createDataFrame(paths, "path string"))
    assert rows(audit.unnest_records(object_lines(read))) == [('{"id":1}',), ('{"id":2}',), ('{"id":3}',), ('{"id":3}',)]
    found = object_rejects(read).select("line", "reason").collect()
    assert sorted((r.line.rsplit("/", 1)[-1], r.reason) for r in found) == [
        ("cut.gz", "cut after 1 lines"),
        ("cut.gz", "cut after 1 lines"),
        ("gone.gz", "missing"),
        ("none.gz", "empty"),
        ("y", "unreadable: OSError"),
    ]
    assert read_objects(spark.createDataFrame([], "path string")).count() == 0


def test_replay_names_odd_paths(spark, tmp_path):
    folder = tmp_path / "in" / "x y"
    folder.mkdir(parents=True)
    (folder / "a b%20+ü.json.gz").write_bytes(gzip.compress(b'{"Records":[{"id":1}]}'))
    (folder / "cut.json.gz").write_bytes(gzip.compress(b'{"Records":[{"id":2}]}\n{"Rec')[:-9])
    read = replayed_objects(spark, f"{tmp_path}/in")
    read.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(**NOW).start(
        f"{tmp_path}/out"
    ).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(os.path.basename(r.path), r.reason) for r in found if r.reason} == {("cut.json.gz", "cut after 1 lines")}
    assert sorted(r.line for r in found if r.line) == ['{"Records":[{"id":1}]}', '{"Records":[{"id":2}]}']


def test_variant_beside_typed_columns(spark):
    texts = ['{"eventName":"a","odd":{"x":[1,{"y":"z"}]}}', "not json", None]
    events = audit.variant_events(spark.createDataFrame([(t,) for t in texts], "event_json string"))
    found = events.select(
        "eventName",
        F.try_variant_get("event", "$.odd.x[1].y", "string").alias("y"),
        F.try_variant_get("event", "$.odd.x[0]", "int").alias("n"),
    )
    assert rows(found) == rows(spark.createDataFrame([("a", "z", 1), (None, None, None), (None, None, None)], found.schema))


def test_functions_over_known_addresses(spark):
    networks = [("10.0.0.0/8", "wide", "W"), ("10.1.0.0/16", "inner", "W"), ("11.0.0.0/8", None, "V")]
    blocks = blocks_from_networks(spark.createDataFrame(networks, "network string, city string, country string"))
    asked = [("10.1.2.3",), ("10.2.0.0",), ("11.1.1.1",), ("host",), (None,), ("10.1.2.3",)]
    table = spark.createDataFrame(asked, "ip string")
    table.createOrReplaceTempView("asked")
    query = "select ip, city(ip) as city, country(ip) as country, place(ip).city as same from asked"
    register_geo_functions(spark, blocks, view="b1")
    want = rows(spark.sql(query))
    register_geo_functions(spark, blocks, view="b2", addresses=table)
    known = spark.sql(query)
    assert rows(known) == want
    assert ("11.1.1.1", None, "V", None) in want
    # An address nobody announced.
    assert spark.sql("select city('10.1.9.9') as c").first().c == "Unknown"


def test_frequencies_against_a_plain_count(spark):
    from collections import defaultdict

    from vigilog.operators.frequency import frequency_alerts

    counts = [("p", b, v, 3 + (b * 7 + len(v or "")) % 3 + 40 * (b == 8190)) for b in range(0, 9000, 3) for v in ("a", "bb")]
    counts += [("p", b, "steady", 4 + (b == 20)) for b in range(21)] + [("p", b, None, 1 + 9 * (b == 8)) for b in range(9)]
    held, want = defaultdict(list), []
    for p, b, v, n in sorted(counts, key=lambda r: r[1]):
        past = held[p, v]
        s, q = sum(past), sum(x * x for x in past)
        if len(past) >= 5 and (len(past) * n - s) ** 2 > 9 * (len(past) * q - s * s):
            want.append((p, v, b, n, len(past), s, q, len(past) * n > s))
        past.append(n)
    frame = spark.createDataFrame(counts, "profiler string, batch_id bigint, value string, n bigint")
    found = [tuple(r) for r in frequency_alerts(frame).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {r[1] for r in want} == {"a", "bb", "steady", None}


@pytest.mark.parametrize("per_part", [2, 1000])
def test_shared_profile_lists_give_each_alert_its_own_profile(spark, monkeypatch, per_part):
    """Lists shared by blocks of alerts, against every earlier value joined with every alert."""
    monkeypatch.setattr(alerts, "BLOCK", 4)
    rng = random.Random(per_part)
    pool = [None, *(f"v{i}" for i in range(40))]
    rows = {(p, P.DEVIATION, b, v) for p in "xyz" for b in range(25) for v in rng.sample(pool, 3)}
    seen = spark.createDataFrame(sorted(rows, key=str), "profiler string, kind string, batch_id long, value string")
    found, profile = profiles.deviations(seen), profiles.first_seen(seen)
    shown = profiles.alert_values(seen, found)
    joined = alerts.deviation_messages(found, shown.unionByName(profiles.profile_lists(profile, found)), per_part)
    shared = alerts.deviation_messages(found, shown, per_part, profile)
    got = sorted(map(tuple, shared.collect()))
    assert got == sorted(map(tuple, joined.collect())) and len(got) > found.count() * (per_part == 2)
    held = alerts.versioned_lists(
        found.selectExpr("profiler", "batch_id", "1L AS parts", "floor(batch_id / 4) AS block"), profile
    )
    assert held.filter("size(held) > 41").isEmpty()


def test_full_access_lines(spark):
    head = "own buck [06/Feb/2019:00:00:38 +0100] 1.2.3.4 me R1 REST.GET k"
    lines = [
        head + ' "GET /a b HTTP/1.1" 200 - x 12 - 3 "-" "a \\"q\\" \\\\ \\z"',
        head,
        "own buck [bad time] - - R2 OP -",
        head + ' "open',
        head + " [a [b] c",
        'own buck [06/Feb/2019:00:00:38 +0000] 1.2.3.4 me "R 1" OP',
        "",
        None,
    ]
    table = spark.createDataFrame([(v,) for v in lines], "value string")
    got = access.parse_full_lines(table).selectExpr(
        "unix_timestamp(time) AS t", "ip", "requestUri", "httpStatus", "bytesSent", "objectSize", "referrer", "userAgent", "key"
    )
    first = (1549407638, "1.2.3.4")
    assert [tuple(r) for r in got.collect()] == [
        (*first, "GET /a b HTTP/1.1", 200, None, 12, "-", 'a "q" \\ \\z', "k"),
        (*first, None, None, None, None, None, None, "k"),
        (None, None, None, None, None, None, None, None, None),
        (*first, '"open', None, None, None, None, None, "k"),
        (*first, "[a", None, None, None, None, None, "k"),
    ]
    assert [tuple(r)[1:] for r in access.full_rejects(table).collect()] == [
        (lines[5], "expected at least 8 fields, found 7"),
        ("", "expected at least 8 fields, found 0"),
        (None, "expected at least 8 fields, found 0"),
    ]
    long = head + " " + " ".join('"open[' + str(i) for i in range(200_000))
    assert access.parse_full_lines(spark.createDataFrame([(long,)], "value string")).count() == 1
