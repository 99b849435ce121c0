"""Audit data derived from the driver's tables.

The tables hold no security logs, so each fixture is a projection of one of
them, written with expressions that read the same in any SQL engine. The
counterparts for the oracle are in :mod:`vigilog.plans.oracle`.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators.geo import blocks_from_ranges
from vigilog.sources.exit_nodes import exit_nodes
from vigilog.sources.objects import store_of

EVENTS_PER_BATCH = 50
ARRIVALS = 6

_ACCOUNT = "cast(100000000000 + user_id % 5 AS string)"
_KEY = (
    "CASE WHEN event_id % 4 = 0 THEN concat('ASIA', event_id) "
    "ELSE concat('AKIA', user_id % 97) END"
)
_ADDRESS = (
    "CASE WHEN event_id % 50 = 7 THEN 'ec2.amazonaws.com' ELSE concat("
    "11 + least(user_id % 30, event_id div 300), '.', user_id % 256, '.', "
    "event_id % 4, '.', 1 + user_id % 200) END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``, spread over the cores where it is a file no task can split."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _json(**members: str) -> str:
    """SQL text of a JSON object; values are SQL, quoted unless they are JSON."""
    parts = []
    for name, sql in members.items():
        quote = "" if sql.startswith("concat('{") else '"'
        parts.append(f"'\"{name}\":{quote}', {sql}, '{quote}'")
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


_EVENT = _json(
    eventVersion="'1.02'",
    userIdentity=_json(
        type="'IAMUser'",
        principalId="concat('AIDA', user_id)",
        arn=f"concat('arn:aws:iam::', {_ACCOUNT}, ':user/u', user_id)",
        accountId=f"CASE WHEN user_id % 37 = 0 THEN concat('AIDA', user_id) ELSE {_ACCOUNT} END",
        accessKeyId=_KEY,
    ),
    eventTime="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    eventSource="concat(event_type, '.amazonaws.com')",
    eventName="event_type",
    awsRegion="'us-west-2'",
    sourceIPAddress=_ADDRESS,
    eventID="concat('e', event_id)",
)


def audit_event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, batch_id, event_json)``: one event per row of ``events``."""
    return event_rows(spark, sf_dir).select(
        "event_id",
        F.expr(f"event_id div {EVENTS_PER_BATCH}").alias("batch_id"),
        F.expr(_EVENT).alias("event_json"),
    )


def as_lines(events: DataFrame) -> DataFrame:
    """Log lines ``{"Records":[...]}``, one per batch of fifty events."""
    return events.groupBy("batch_id").agg(
        F.concat(
            F.lit('{"Records":['), F.array_join(F.collect_list("event_json"), ","), F.lit("]}")
        ).alias("value")
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of one event each, which take no shuffle to make."""
    return audit_event_texts(spark, sf_dir).select(
        F.concat(F.lit('{"Records":['), "event_json", F.lit("]}")).alias("value")
    )


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(audit_event_texts(spark, sf_dir)).select("value")


EVENTS_PER_OBJECT = 500


def _planted(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            first, second = (gzip.compress(f"{line}\n".encode(), mtime=0) for line in (row["first"], row["second"]))
            kind = row["object"] % 5
            content = {
                0: first + second,
                1: first + second[: len(second) // 2],
                3: gzip.compress(b"", mtime=0),
                4: row["first"].encode(),
            }.get(kind)
            if content is not None:
                store, path = store_of(f"{folder}/o{row['object']}.json.gz")
                store.create_dir(path.rsplit("/", 1)[0])
                with store.open_output_stream(path, compression=None) as out:
                    out.write(content)
        yield batch.select(["object"])


def plant_objects(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Writes objects of 500 events each and returns their ``object`` numbers.

    An object has two lines, of its even and its odd events. By number modulo five it is whole, cut in its second
    line, not there at all, empty, or text without gzip.
    """
    events = audit_event_texts(spark, sf_dir).withColumn("object", F.expr(f"event_id div {EVENTS_PER_OBJECT}"))

    def line(rest: int) -> Column:
        held = F.collect_list(F.when(F.col("event_id") % 2 == rest, F.col("event_json")))
        return F.concat(F.lit('{"Records":['), F.array_join(held, ","), F.lit("]}"))

    contents = events.groupBy("object").agg(line(0).alias("first"), line(1).alias("second"))
    return contents.mapInArrow(partial(_planted, folder), "object long")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with other root fields, blank lines and lines that are not JSON."""
    return table(spark, sf_dir, "events").select(
        F.expr(
            """
            CASE event_id % 5
              WHEN 0 THEN concat('{"Records":[{"id":', event_id, '},{"id":-', event_id, '}],"n":1}')
              WHEN 1 THEN concat('{"Records":[],"Extra":["x', event_id, '",', event_id, ']}')
              WHEN 2 THEN concat('{"version":"', event_id, '"}')
              WHEN 3 THEN concat('{"Records":[{"id":', event_id)
              ELSE '' END
            """
        ).alias("value")
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events cut into a fixed number of arrivals, in order, for streams."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).scalar()
    return (
        audit_event_texts(spark, sf_dir)
        .withColumn("last", last)
        .select(
            F.expr(f"(event_id * {ARRIVALS}) div (last + 1)").alias("arrival"),
            "batch_id",
            "event_json",
        )
    )


def deep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, event_json)`` with the profiled keys in every kind of place."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(
            r"""
            CASE event_id % 9
              WHEN 0 THEN concat('{"arn":"a', event_id % 11, '"}')
              WHEN 1 THEN concat('{"userIdentity":{"arn":"u', user_id, '","sessionContext":',
                '{"sessionIssuer":{"arn":"i', user_id % 7, '"}},"accessKeyId":"AKIA', user_id, '"}}')
              WHEN 2 THEN concat('{"resources":[{"arn":"r1"},{"arn":"r', event_id % 5, '"},{"arn":"r1"}]}')
              WHEN 3 THEN '{"x":{"arn":null},"y":[]}'
              WHEN 4 THEN concat('{"arn":', event_id, ',"q":{"w":[[{"accessKeyId":"deep', user_id, '"}]]}}')
              WHEN 5 THEN concat('{"arn":{"arn":"inner","accessKeyId":"in', user_id, '"},"z":{"arn":"o"}}')
              WHEN 6 THEN '{"note":"{\\"arn\\":\\"no\\"}","ARN":"no","list":["arn"]}'
              WHEN 7 THEN concat('{"arn":true,"accessKeyId":["', user_id, '"]}')
              ELSE concat('{"arn":"say \\"', user_id, '\\" \\u00e9"}') END
            """
        ).alias("event_json"),
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.expr("(11 + n_nationkey) * 16777216L").alias("lo"),
        F.expr("(12 + n_nationkey) * 16777216L - 1").alias("hi"),
        F.expr("CASE WHEN n_nationkey % 9 = 4 THEN NULL ELSE n_name END").alias("city"),
        F.col("r_name").alias("country"),
    )


def geo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_ranges(geo_ranges(spark, sf_dir))


def network_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(network, geoname_id)``: IPv4 networks of ten lengths, a /8 over many of them, and IPv6."""
    customers = table(spark, sf_dir, "customer")
    small = customers.selectExpr(
        "concat(c_custkey % 256, '.', c_custkey * 7 % 256, '.', c_custkey % 4 * 64, '.0/', 15 + c_custkey % 10)"
        " AS network",
        "c_custkey AS geoname_id",
    )
    nations = table(spark, sf_dir, "nation")
    wide = nations.selectExpr("concat(n_nationkey * 9, '.0.0.0/8') AS network", "-1 - n_nationkey AS geoname_id")
    six = nations.selectExpr(
        "concat('fd00::', lower(hex(n_nationkey * 2048)), '/', 112 + n_nationkey % 6) AS network",
        "-1 - n_nationkey AS geoname_id",
    )
    return small.unionByName(wide).unionByName(six)


def network_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(geoname_id, city_name, country_name)``; some cities have no name."""
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    of_customers = customers.selectExpr(
        "c_custkey AS geoname_id",
        "CASE WHEN c_custkey % 9 > 0 THEN concat('city ', c_custkey) END AS city_name",
        "n_name AS country_name",
    )
    of_nations = nations.selectExpr(
        "-1 - n_nationkey AS geoname_id", "concat('all ', n_name) AS city_name", "n_name AS country_name"
    )
    return of_customers.unionByName(of_nations)


def exit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_exit_lines(spark, sf_dir).select("value")


def numbered_exit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("number"),
        F.expr(
            """
            CASE WHEN s_suppkey % 3 = 0 THEN concat('ExitAddress ', 11 + s_suppkey % 30, '.',
                   s_suppkey % 256, '.', s_suppkey % 4, '.', 1 + s_suppkey % 200,
                   ' 2015-09-27 23:17:58')
                 WHEN s_suppkey % 15 = 1 THEN 'ExitAddress'
                 WHEN s_suppkey % 15 = 2 THEN concat('ExitAddress 300.1.2.', s_suppkey % 256, ' x')
                 ELSE concat('ExitNode ', s_suppkey) END
            """
        ).alias("value"),
    )


def exit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exit_nodes(exit_lines(spark, sf_dir))


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr(
            """
            concat('cust', o_custkey, ' bucket-', o_orderstatus, ' [',
              date_format(o_orderdate, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] 10.',
              o_custkey % 256, '.', o_custkey % 7, '.', 1 + o_custkey % 200,
              ' user', o_custkey % 50, ' REQ', o_orderkey, ' REST.',
              replace(o_orderpriority, ' ', '-'),
              CASE WHEN o_orderkey % 11 = 0 THEN ''
                   ELSE concat(' key/', o_orderkey, ' "GET /x HTTP/1.1" 200') END,
              CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE '' END)
            """
        ).alias("value")
    )


def full_access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the whole grammar: by key modulo seven cut before the key, cut after it, cut after the size, dashes
    for what may be missing, an agent with escaped quotes, all fields, and two fields that nobody knows."""
    start = F.expr(
        """concat('cust', o_custkey, ' bucket-', o_orderstatus, ' [',
           date_format(o_orderdate, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] 10.', o_custkey % 256, '.', o_custkey % 7, '.',
           1 + o_custkey % 200, ' user', o_custkey % 50, ' REQ', o_orderkey, ' REST.', replace(o_orderpriority, ' ', '-'))"""
    )
    key = F.expr("concat(' key/', o_orderkey)")
    request = F.expr("""concat(' "GET /key/', o_orderkey, ' HTTP/1.1" ', 200 + o_custkey % 5, ' - ', o_orderkey * 3, ' ', o_orderkey)""")
    agent = F.when(F.expr("o_orderkey % 7 = 4"), F.lit(' "say \\"hi\\" [1]"')).otherwise(F.lit(' "Agent/1 [x]"'))
    rest = F.concat(
        F.expr("""concat(' ', o_custkey, ' 7 "http://r/', o_custkey, '"')"""), agent,
        F.lit(" - host= SigV4 AES AuthHeader b.example.com TLSv1.2 - Yes"),
    )
    dashes = F.lit(" -" * 18)
    kind = F.col("o_orderkey") % 7
    value = (
        F.when(kind == 0, start)
        .when(kind == 1, F.concat(start, key))
        .when(kind == 2, F.concat(start, key, request))
        .when(kind == 3, F.concat(start, key, dashes))
        .when(kind == 6, F.concat(start, key, request, rest, F.lit(' new "two words"')))
        .otherwise(F.concat(start, key, request, rest))
    )
    return table(spark, sf_dir, "orders").select(value.alias("value"))


def notification_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th is malformed, in one of eight ways."""
    message = F.expr(
        """
        CASE
          WHEN event_id % 17 <> 0 THEN concat('{"s3Bucket":"', event_type, '","s3ObjectKey":["k',
            event_id, '"', CASE WHEN event_id % 3 > 0 THEN concat(',"l', event_id, '"') ELSE '' END,
            CASE WHEN event_id % 3 > 1 THEN concat(',"k', event_id, '"') ELSE '' END, ']}')
          WHEN event_id div 17 % 8 = 2 THEN concat('{"s3Bucket":"', event_type,
            '","x":{"s3Bucket":"', event_type, '"},"s3ObjectKey":["k"]}')
          WHEN event_id div 17 % 8 = 3 THEN concat('{"s3Bucket":"', event_type, '","s3ObjectKey":[]}')
          WHEN event_id div 17 % 8 = 4 THEN concat('{"s3Bucket":"', event_type, '","s3ObjectKey":[',
            event_id, ',"m', event_id, '"]}')
          WHEN event_id div 17 % 8 = 5 THEN concat('{"s3Bucket":"', event_type, '"}')
          WHEN event_id div 17 % 8 = 6 THEN concat('{"s3Bucket":"', event_type, '","s3ObjectKey":[""]}')
          ELSE 'plain words' END
        """
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.expr("event_id % 17 = 0 AND event_id div 17 % 8 = 0"), "{broken")
        .when(F.expr("event_id % 17 = 0 AND event_id div 17 % 8 = 1"), '{"Type":"Notification"}')
        .otherwise(
            F.concat(
                F.lit('{"Type":"Notification","Message":"'),
                F.replace(message, F.lit('"'), F.lit('\\"')),
                F.lit('"}'),
            )
        )
        .alias("value"),
    )


def log_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bucket"),
        F.expr("CASE WHEN user_id % 5 > 0 THEN concat('p', user_id % 5) END").alias("prefix"),
    )


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bucket"),
        F.expr(
            "concat('p', event_id % 7, '/o', event_id, "
            "CASE event_id % 3 WHEN 0 THEN '.json.gz' WHEN 1 THEN '.json' ELSE '.JSON.GZ' END)"
        ).alias("key"),
    )


def address_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address text in all accepted spellings and some that are not."""
    return table(spark, sf_dir, "events").select(
        F.expr(
            """
            CASE event_id % 8
              WHEN 0 THEN concat(event_id % 300, '.', user_id % 256, '.', event_id % 4, '.7')
              WHEN 1 THEN concat('::ffff:10.', user_id % 256, '.0.', event_id % 256)
              WHEN 2 THEN concat('fd00::', lower(hex(event_id % 65536)))
              WHEN 3 THEN concat('[2001:db8:0:0:0:0:', lower(hex(user_id % 65536)), ':1]')
              WHEN 4 THEN concat('host-', event_id, '.example.com')
              WHEN 5 THEN concat(event_id % 256, '.', user_id)
              WHEN 6 THEN concat('1::2::', event_id % 10)
              ELSE '' END
            """
        ).alias("ip")
    )


