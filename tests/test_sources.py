import gzip
import json

import pytest
from frames import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vigilog.options import Options
from vigilog.plans import tables
from vigilog.sources import access, audit
from vigilog.sources.notifications import (
    announced_objects,
    notification_rejects,
    unwrap_notifications,
)


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))


EVENT = {
    "eventName": "Run",
    "eventSource": "ec2.amazonaws.com",
    "sourceIPAddress": "1.2.3.4",
    "userIdentity": {"principalId": "P", "accountId": "P", "accessKeyId": "AKIA1"},
    "requestParameters": {"a": [1, 2]},
}


def line(*events, **more):
    return json.dumps({"Records": list(events), **more}, separators=(",", ":"))


def test_source_catalogue_and_listing(spark):
    sources = spark.createDataFrame(
        [("b", "p"), ("b", "p"), ("b", "pq"), ("c", None), ("d", "x")], "bucket string, prefix string"
    )
    assert audit.source_catalogue(sources).count() == 4
    assert audit.source_paths(sources) == ["s3a://b/p*", "s3a://b/pq*", "s3a://c/*", "s3a://d/x*"]
    listing = spark.createDataFrame(
        [("b", "pq/1.json.gz"), ("b", "q/1.json.gz"), ("b", "p1.json"), ("c", "any.json.gz"),
         ("c", "ANY.JSON.GZ"), ("d", "p/1.json.gz"), ("e", "x.json.gz")],
        "bucket string, key string",
    )
    assert rows(audit.objects_of_sources(listing, sources)) == [("b", "pq/1.json.gz"), ("c", "any.json.gz")]


def test_read_lines_by_prefix_and_suffix(spark, tmp_path):
    put(tmp_path / "logs-a" / "x" / "1.json.gz", line(EVENT) + "\n" + line(EVENT, EVENT))
    put(tmp_path / "logs-b" / "2.json.gz", line(EVENT))
    put(tmp_path / "logs-b" / "2.txt.gz", "no")
    put(tmp_path / "other" / "3.json.gz", line(EVENT))
    lines = audit.read_lines(spark, f"{tmp_path}/logs*")
    assert lines.count() == 3
    assert audit.unnest_records(lines).count() == 4
    twice = audit.read_lines(spark, [f"{tmp_path}/other", f"{tmp_path}/other"])
    assert twice.count() == 1


def test_truncated_object_fails_or_yields_nothing(spark, tmp_path):
    put(tmp_path / "1.json.gz", line(EVENT))
    (tmp_path / "2.json.gz").write_bytes(gzip.compress(line(*[EVENT] * 500).encode())[:60])
    with pytest.raises(Exception, match="(?s).*"):
        audit.read_lines(spark, str(tmp_path)).collect()
    assert audit.read_lines(spark, str(tmp_path), tolerant=True).count() == 1


def test_unnest_and_rejects(spark):
    lines = texts(
        spark,
        [line({"a": 1}, {"b": "x"}), line(), line({"c": 2}, n=5, list=[7, "s"]), "", "   ", "{bad", '{"x":1}'],
    )
    assert rows(audit.unnest_records(lines)) == [('{"a":1}',), ('{"b":"x"}',), ('{"c":2}',)]
    assert rows(audit.unnest_all_fields(lines)) == [
        ('"s"',), ("7",), ('{"a":1}',), ('{"b":"x"}',), ('{"c":2}',)
    ]
    assert rows(audit.line_rejects(lines).select("line", "reason")) == [
        ('{"x":1}', "no Records list"), ("{bad", "not JSON")
    ]


def test_typed_and_inferred_events(spark):
    lines = texts(spark, [line(EVENT)])
    typed = audit.typed_records(lines).first()
    assert typed.userIdentity.principalId == "P" and json.loads(typed.requestParameters) == {"a": [1, 2]}
    events = audit.unnest_records(lines)
    kept = audit.typed_events(events).first()
    assert json.loads(kept.event_json) == EVENT and kept.sourceIPAddress == "1.2.3.4"
    inferred = audit.inferred_events(events)
    assert inferred.select("requestParameters.a", "userIdentity.accessKeyId").first() == ([1, 2], "AKIA1")


def test_filter_stays_above_the_parse(spark):
    plan = audit.typed_records(texts(spark, [line(EVENT)])).filter("eventName = 'Run'")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_audit_tables(spark, tmp_path):
    put(tmp_path / "in" / "1.json.gz", line(EVENT, {**EVENT, "eventTime": "2015-10-03T01:36:22Z"}))
    tables.create_audit_table(spark, f"{tmp_path}/in", cache=False)
    assert spark.sql("select distinct sourceIpAddress from cloudtrail").collect() == [("1.2.3.4",)]
    saved = tables.create_audit_saved_table(spark, f"{tmp_path}/in", f"{tmp_path}/t", by_date=True)
    assert rows(saved.select(F.col("event_date").cast("string"))) == [("2015-10-03",), (None,)]
    plan = spark.table("cloudtrailhive").filter("userIdentity.principalId = 'P'").select("eventName")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(userIdentity.principalId,P)" in shown and "requestParameters" not in shown
    with pytest.raises(AnalysisException):
        tables.create_audit_saved_table(spark, f"{tmp_path}/in", f"{tmp_path}/t")
    spark.sql("drop table cloudtrailhive")


ACCESS = [
    "own buck [06/Feb/2014:00:00:38 +0000] 192.0.2.3 req RID OP key",
    "own buck [06/Feb/2014:00:00:38 +0000] 192.0.2.3 req RID OP key more words",
    "own buck [06/Feb/2014:00:00:38 +0000] 192.0.2.3 req RID OP",
    "own buck [06/Feb/2014:00:00:38 +0000] 192.0.2.3 req RID OP ",
    "own  buck [06/Feb/2014:00:00:38 +0000] 192.0.2.3 req RID OP key",
    "",
    "          ",
]


def test_access_lines(spark, tmp_path):
    lines = texts(spark, ACCESS)
    good = ("own", "buck", "[06/Feb/2014:00:00:38 +0000]", "192.0.2.3", "req", "OP", "key")
    shifted = ("own", "", "buck [06/Feb/2014:00:00:38", "+0000]", "192.0.2.3", "RID", "OP")
    assert rows(access.parse_access_lines(lines)) == [shifted, good, good]
    assert access.access_rejects(lines).count() == 4
    (tmp_path / "logs1").write_text("\n".join(ACCESS))
    (tmp_path / "other").write_text(ACCESS[0])
    tables.create_access_table(spark, f"{tmp_path}/logs", cache=False)
    assert spark.sql("select distinct ip from s3logs").count() == 2
    saved = tables.create_access_saved_table(spark, f"{tmp_path}/logs", f"{tmp_path}/t")
    assert saved.count() == 3
    spark.sql("drop table s3logshive")
    assert access.read_access_lines(spark, f"{tmp_path}/logs", 5).rdd.getNumPartitions() == 5


BODY = """{
  "Type" : "Notification", "MessageId" : "m-1",
  "Message" : "{\\"s3Bucket\\":\\"log-store\\",\\"s3ObjectKey\\":[\\"year/day/one\\"]}",
  "Timestamp" : "2020-01-02T03:04:05Z"
}"""


def notice(message):
    return json.dumps({"Message": message if isinstance(message, str) else json.dumps(message)})


def test_notifications(spark):
    bodies = texts(
        spark,
        [
            BODY,
            notice({"s3Bucket": "b", "s3ObjectKey": ["k1", "k2", "k1"]}),
            json.dumps({"deep": [{"Message": json.dumps({"x": {"s3Bucket": "d"}, "s3ObjectKey": ["k"]})}]}),
            "not json",
            "{}",
            notice("plain"),
            notice({"s3Bucket": "b", "y": {"s3Bucket": "b"}, "s3ObjectKey": ["k"]}),
            notice({"s3ObjectKey": ["k"]}),
            notice({"s3Bucket": "b"}),
            notice({"s3Bucket": "b", "s3ObjectKey": []}),
            notice({"s3Bucket": "b", "s3ObjectKey": [5, "mixed"]}),
            notice({"s3Bucket": "", "s3ObjectKey": ["k"]}),
            notice({"s3Bucket": "b", "s3ObjectKey": [""]}),
        ],
    )
    unwrapped = unwrap_notifications(bodies)
    assert rows(announced_objects(unwrapped)) == [
        ("b", "k1"), ("b", "k2"), ("b", "mixed"), ("d", "k"), ("log-store", "year/day/one")
    ]
    assert sorted(r.reason for r in notification_rejects(unwrapped).collect()) == [
        "Message is not JSON", "empty bucket", "empty key", "empty s3ObjectKey",
        "expected one s3Bucket, found 0", "expected one s3Bucket, found 2",
        "key is not text", "no Message", "no s3ObjectKey", "not JSON",
    ]


def test_options():
    options = Options.from_lines(["# note", "batchIntervalSeconds=30", " appName = x ", "cloudTrailPrefix="])
    assert options.integer("batchIntervalSeconds") == 30 and options.text("appName") == "x"
    assert options.text("cloudTrailPrefix", allow_empty=True) == ""
    with pytest.raises(ValueError):
        options.text("cloudTrailPrefix")
