import ipaddress
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from vigilog.functions.addresses import V4_BASE, ip_to_long, parse_address
from vigilog.operators.exits import from_exit_nodes, with_exit_flag
from vigilog.operators.geo import (
    UNKNOWN,
    blocks_from_networks,
    blocks_from_ranges,
    geo_lookup,
    prefix_lengths,
    read_blocks,
    register_geo_functions,
)
from vigilog.sources.exit_nodes import (
    exit_node_rejects,
    exit_nodes,
    no_exit_nodes,
    read_exit_nodes,
)

RANGES = "lo long, hi long, city string, country string"


def halves(value: int) -> tuple[int, int]:
    def signed(n):
        return n - (1 << 64) if n >= 1 << 63 else n

    return signed(value >> 64), signed(value & ((1 << 64) - 1))


def parsed(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "ip string")
    return {
        r.ip: (tuple(r.a) if r.a else None) for r in frame.select("ip", parse_address("ip").alias("a")).collect()
    }


def test_random_literals_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    v6 = []
    for _ in range(300):
        groups = [rng.choice([0, 0, rng.getrandbits(16)]) for _ in range(8)]
        address = ipaddress.IPv6Address(int.from_bytes(b"".join(g.to_bytes(2, "big") for g in groups)))
        v6 += [str(address), address.exploded, f"[{address}]"]
    found = parsed(spark, v4 + v6)
    for text in v4:
        assert found[text] == (0, V4_BASE + int(ipaddress.IPv4Address(text))), text
    for text in v6:
        assert found[text] == halves(int(ipaddress.IPv6Address(text.strip("[]")))), text


def test_short_forms_mapped_forms_and_bad_text(spark):
    found = parsed(spark, ["1.2.3", "1.2", "7", "0001.2.3.4", "::ffff:1.2.3.4", "fe80::1%3"])
    v4 = {k: v[1] - V4_BASE for k, v in found.items() if ":" not in k}
    assert v4 == {"1.2.3": 0x01020003, "1.2": 0x01000002, "7": 7, "0001.2.3.4": 0x01020304}
    assert found["::ffff:1.2.3.4"] == (0, V4_BASE + 0x01020304)
    assert found["fe80::1%3"] == halves(int(ipaddress.IPv6Address("fe80::1")))
    bad = ["", "256.1.1.1", "1.2.3.4.5", "1.2.3.", "4294967296", "host.example.com", ":::",
           "1::2::3", "1:2:3:4:5:6:7::8", "1:2:3", "::1.2.3.256", "12345::", "1.2.3.4 ", None]
    assert set(parsed(spark, bad).values()) == {None}


def test_ip_to_long_is_null_beyond_v4(spark):
    frame = spark.createDataFrame([("10.0.0.1",), ("::1",), ("x",)], "ip string")
    assert rows(frame.select("ip", ip_to_long("ip"))) == [("10.0.0.1", 167772161), ("::1", None), ("x", None)]


@pytest.fixture(scope="module")
def blocks(spark):
    ranges = spark.createDataFrame(
        [(10 << 24, (11 << 24) - 1, "ten", "X"), (5, 9, None, "Y"), ((1 << 32) - 1, (1 << 32) - 1, "top", "T")],
        RANGES,
    )
    networks = spark.createDataFrame(
        [("2001:db8::/32", "six", "S"), ("12.34.0.0/16", "small", None)],
        "network string, city string, country string",
    )
    return blocks_from_ranges(ranges).unionByName(blocks_from_networks(networks))


def test_lookup_edges_gaps_and_nulls(spark, blocks):
    expected = {
        "10.0.0.0": ("ten", "X"),
        "10.255.255.255": ("ten", "X"),
        "9.255.255.255": (UNKNOWN, UNKNOWN),
        "11.0.0.0": (UNKNOWN, UNKNOWN),
        "0.0.0.4": (UNKNOWN, UNKNOWN),
        "0.0.0.5": (None, "Y"),
        "0.0.0.9": (None, "Y"),
        "0.0.0.10": (UNKNOWN, UNKNOWN),
        "255.255.255.255": ("top", "T"),
        "12.34.56.78": ("small", None),
        "2001:db8::9": ("six", "S"),
        "2001:db9::9": (UNKNOWN, UNKNOWN),
        "::ffff:10.1.1.1": ("ten", "X"),
        "host": (UNKNOWN, UNKNOWN),
        "": (UNKNOWN, UNKNOWN),
        None: (UNKNOWN, UNKNOWN),
    }
    frame = spark.createDataFrame([(t,) for t in expected], "ip string").distinct()
    assert {r.ip: (r.city, r.country) for r in geo_lookup(frame, "ip", blocks).collect()} == expected
    register_geo_functions(spark, blocks)
    frame.createOrReplaceTempView("addresses")
    by_sql = spark.sql("select ip, city(ip) as city, country(ip) as country from addresses")
    assert {r.ip: (r.city, r.country) for r in by_sql.collect()} == expected


def test_ranges_fall_apart_into_exact_blocks(spark):
    rng = random.Random(3)
    pairs = [(0, (1 << 32) - 1), (0, 0)] + [
        tuple(sorted((rng.getrandbits(32), rng.getrandbits(32)))) for _ in range(40)
    ]
    frame = spark.createDataFrame([(lo, hi, f"{lo}-{hi}", "c") for lo, hi in pairs], RANGES)
    got = {}
    for r in blocks_from_ranges(frame).collect():
        got.setdefault(r.city, []).append((r.lo - V4_BASE, 128 - r.plen))
    for lo, hi in pairs:
        nets = ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi))
        assert sorted(got[f"{lo}-{hi}"]) == sorted((int(n.network_address), 32 - n.prefixlen) for n in nets)


def test_random_lookups_agree_with_brute_force(spark):
    rng = random.Random(11)
    cuts = sorted(rng.sample(range(1 << 32), 120))
    ranges = [(cuts[i], cuts[i + 1] - 1, f"c{i}", "k") for i in range(0, 118, 2)]
    blocks = blocks_from_ranges(spark.createDataFrame(ranges, RANGES))
    values = [rng.getrandbits(32) for _ in range(400)] + [r[0] for r in ranges] + [r[1] for r in ranges]
    frame = spark.createDataFrame([(str(ipaddress.IPv4Address(v)),) for v in values], "ip string").distinct()
    for r in geo_lookup(frame, "ip", blocks).collect():
        v = int(ipaddress.IPv4Address(r.ip))
        hit = [c for lo, hi, c, _ in ranges if lo <= v <= hi]
        assert r.city == (hit[0] if hit else UNKNOWN)


def test_lookup_shuffles_when_blocks_are_not_small(spark, blocks):
    frame = spark.createDataFrame([("10.1.1.1",), ("8.8.8.8",)], "ip string").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = geo_lookup(frame, "ip", blocks, prefix_lengths(blocks))
        assert rows(looked) == [("10.1.1.1", "ten", "X"), ("8.8.8.8", UNKNOWN, UNKNOWN)]
        assert "NestedLoop" not in looked._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LIST = [
    "ExitNode AB12CD34AB12CD34AB12CD34AB12CD34AB12CD34",
    "ExitAddress 198.51.100.7 2020-01-02 03:04:05",
    "ExitAddress 198.51.100.7 2020-01-03 00:00:00",
    "x ExitAddress 1.2.3.4",
    "ExitAddress",
    "ExitAddress not.an.address 2015",
    "note 9.9.9.9 ExitAddress",
    "ExitAddress ::ffff:5.6.7.8 2015",
]


def test_exit_list(spark, tmp_path):
    lines = spark.createDataFrame([(line,) for line in LIST], "value string")
    assert rows(exit_nodes(lines).select("ip")) == [("198.51.100.7",), ("9.9.9.9",), ("::ffff:5.6.7.8",)]
    assert rows(exit_node_rejects(lines).select("line", "reason")) == [
        ("ExitAddress", "no address"),
        ("ExitAddress not.an.address 2015", "not an address"),
        ("x ExitAddress 1.2.3.4", "not an address"),
    ]
    assert read_exit_nodes(spark, str(tmp_path / "nowhere")).count() == 0
    assert exit_nodes(lines).select("retrieved_at").first()[0] is not None


def test_membership_compares_values_not_spelling(spark):
    nodes = exit_nodes(spark.createDataFrame([(line,) for line in LIST], "value string"))
    frame = spark.createDataFrame([("5.6.7.8",), ("5.6.7.9",), ("host",), (None,)], "ip string")
    assert rows(from_exit_nodes(frame, "ip", nodes)) == [("5.6.7.8",)]
    flags = with_exit_flag(frame, "ip", nodes)
    assert {r.ip: r.is_exit for r in flags.collect()} == {
        "5.6.7.8": True, "5.6.7.9": False, "host": False, None: False,
    }
    assert not with_exit_flag(frame, "ip", no_exit_nodes(spark)).filter(F.col("is_exit")).count()


def test_blocks_from_database_files(spark, tmp_path):
    (tmp_path / "networks.csv").write_text(
        "network,geoname_id,extra\n1.2.3.0/24,5,x\n2001:db8::/33,6,y\n9.0.0.0/8,,z\n"
    )
    (tmp_path / "names.csv").write_text("geoname_id,city_name,country_name\n5,Five,Land\n6,,Land\n")
    blocks = read_blocks(spark, f"{tmp_path}/networks.csv", f"{tmp_path}/names.csv")
    frame = spark.createDataFrame([("1.2.3.4",), ("2001:db8::1",), ("9.9.9.9",), ("8.8.8.8",)], "ip string")
    assert rows(geo_lookup(frame.distinct(), "ip", blocks)) == [
        ("1.2.3.4", "Five", "Land"), ("2001:db8::1", None, "Land"), ("8.8.8.8", UNKNOWN, UNKNOWN),
        ("9.9.9.9", None, None),
    ]
