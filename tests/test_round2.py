"""Faults found in review: nothing old, oddly named or overlapping is lost or misread."""

import json
import os
import time

from frames import rows
from vigilog.operators import profiles
from vigilog.operators import profilers as P
from vigilog.operators.exits import with_flags
from vigilog.operators.geo import blocks_from_networks, geo_lookup, register_geo_functions
from vigilog.operators.profilers import Profiler
from vigilog.plans import tables
from vigilog.sources import audit
from vigilog.streaming.inputs import replay_events, start_notification_ingest


def put(spark, folder, event):
    line = json.dumps({"Records": [event]})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").option(
        "compression", "gzip"
    ).text(folder)
    for name in os.listdir(folder):
        if name.endswith(".txt.gz"):
            os.rename(f"{folder}/{name}", f"{folder}/{name[:-7]}.json.gz")


def test_objects_of_any_age_are_replayed(spark, tmp_path):
    folder, out = f"{tmp_path}/objects", f"{tmp_path}/out"
    put(spark, folder, {"n": 1})

    def run():
        stream = replay_events(spark, folder).writeStream.format("parquet").option("path", out)
        stream = stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
        stream.start().awaitTermination()

    run()
    put(spark, f"{folder}/late", {"n": 2})
    old = time.time() - 30 * 86_400
    for name in os.listdir(f"{folder}/late"):
        os.utime(f"{folder}/late/{name}", (old, old))
    run()
    assert spark.read.parquet(out).count() == 2


def test_a_bucket_name_is_not_a_pattern(spark, tmp_path):
    put(spark, f"{tmp_path}/data/other", {"n": 1})
    (name,) = [n for n in os.listdir(f"{tmp_path}/data/other") if n.endswith(".json.gz")]
    body = json.dumps({"Message": json.dumps({"s3Bucket": "*", "s3ObjectKey": [name]})})
    spark.createDataFrame([(body,)], "value string").write.text(f"{tmp_path}/bodies")
    start_notification_ingest(
        spark, f"{tmp_path}/bodies", f"{tmp_path}/data/{{bucket}}/{{key}}", f"{tmp_path}/staged",
        f"{tmp_path}/checkpoint", trigger={"availableNow": True},
    ).awaitTermination()
    events = spark.read.option("recursiveFileLookup", "true").schema("event_json string")
    assert events.parquet(f"{tmp_path}/staged/events").count() == 0
    assert spark.read.parquet(f"{tmp_path}/staged/rejects").filter("source = 'object'").count() == 1


def test_inference_keeps_names(spark):
    texts = ['{"VARIANT_id":1,"OBJECT":{"VOID":null,"AVOID":true,"a: VARIANT":2}}']
    events = spark.createDataFrame([(t,) for t in texts], "event_json string")
    found = audit.inferred_events(events)
    assert found.columns == ["OBJECT", "VARIANT_id"] or set(found.columns) == {"OBJECT", "VARIANT_id"}
    assert found.select("VARIANT_id", "OBJECT.AVOID", "OBJECT.`a: VARIANT`").first() == (1, True, 2)


def test_the_longest_prefix_names_the_place(spark):
    networks = [("10.0.0.0/8", "zzz", "Z"), ("10.1.0.0/16", "aaa", "A")]
    blocks = blocks_from_networks(spark.createDataFrame(networks, "network string, city string, country string"))
    frame = spark.createDataFrame([("10.1.2.3",), ("10.2.0.1",)], "ip string")
    assert rows(geo_lookup(frame, "ip", blocks)) == [("10.1.2.3", "aaa", "A"), ("10.2.0.1", "zzz", "Z")]
    register_geo_functions(spark, blocks, "round2_blocks")
    assert spark.sql("SELECT city('10.1.2.3'), country('10.1.2.3')").first() == ("aaa", "A")


def test_text_literals_are_not_columns():
    assert not Profiler("p", "f", keep="value <> 'velocity'").uses("city")
    assert not Profiler("p", "f", keep="value <> 'city'").uses("city")
    assert Profiler("p", "f", value="city").uses("city", "country")


def test_whole_buckets_and_prefixes(spark):
    listing = spark.createDataFrame(
        [("a", "x1.json.gz"), ("a", "y1.json.gz"), ("b", "x1.json.gz"), ("b", "y.json")], "bucket string, key string"
    )
    sources = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "bucket string, prefix string")
    assert rows(audit.objects_of_sources(listing, sources)) == [
        ("a", "x1.json.gz"), ("a", "y1.json.gz"), ("b", "x1.json.gz")
    ]
    assert audit.objects_of_sources(listing, sources.filter("bucket = 'a' and prefix is null")).count() == 2


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_counts_do_not_join_on_values(spark):
    seen = spark.createDataFrame([("p", P.DEVIATION, 0, "a")], "profiler string, kind string, batch_id long, value string")
    joins = [line for line in plan_of(profiles.batch_counts(seen)).split("\n") if " Join " in line]
    assert len(joins) == 2 and not any("value#" in line for line in joins)


def test_addresses_are_looked_up_once_and_alone(spark):
    """Rows without an address stay out of every join."""
    observed = spark.createDataFrame(
        [(b, "sourceIPAddress", "10.1.2.3") for b in range(9)] + [(1, "sourceIPAddress", None), (1, "arn", "r")],
        "batch_id long, field string, value string",
    )
    blocks = blocks_from_networks(
        spark.createDataFrame([("10.0.0.0/8", "c", "L")], "network string, city string, country string")
    )
    chosen = [P.GEO_CITY_PROFILER, P.GEO_COUNTRY_PROFILER, P.ARN_PROFILER]
    found = P.candidates(observed, chosen, blocks)
    assert sorted((r.profiler, r.batch_id, r.value) for r in found.collect()) == sorted(
        [("SourceIP-City", b, "c") for b in range(9)] + [("SourceIP-Country", b, "L") for b in range(9)]
        + [("SourceIP-City", 1, "Unknown"), ("SourceIP-Country", 1, "Unknown"), ("arn", 1, "r")]
    )
    others = [line for line in plan_of(P.with_places_once(observed, chosen, blocks, None)).split("\n") if "Filter" in line]
    assert any("NOT (field#" in line for line in others) and any("(field#" in line and "NOT" not in line for line in others)


def test_rows_without_an_address_match_no_node(spark):
    rows_in = spark.createDataFrame([("x", None, None), ("y", 0, 7)], "value string, _hi long, _lo long")
    nodes = spark.createDataFrame([(0, 7), (0, -1)], "hi long, lo long")
    assert rows(with_flags(rows_in, nodes).select("value", "is_exit")) == [("x", False), ("y", True)]


def test_rejects_are_written_where_named(spark, tmp_path):
    put(spark, f"{tmp_path}/in", {"requestID": "r1", "userIdentity": {"sessionContext": {"attributes": {"mfaAuthenticated": "true"}}}})
    (tmp_path / "access1").write_text("too few words\n")
    spark.createDataFrame([("{broken",)], "value string").write.option("compression", "gzip").text(f"{tmp_path}/bad")
    for name in os.listdir(tmp_path / "bad"):
        if name.endswith(".txt.gz"):
            os.rename(f"{tmp_path}/bad/{name}", f"{tmp_path}/in/{name[:-7]}.json.gz")
    found = tables.create_audit_table(spark, f"{tmp_path}/in", cache=False, rejects=f"{tmp_path}/rejects")
    assert found.select("requestID", "userIdentity.sessionContext.attributes.mfaAuthenticated").collect() == [("r1", "true")]
    tables.create_access_table(spark, f"{tmp_path}/access", cache=False, rejects=f"{tmp_path}/rejects")
    assert sorted(r.source for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == ["access", "audit"]
