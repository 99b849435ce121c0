"""City and country of an address: a lookup in blocks that do not overlap.

An address lies in a block of prefix length ``p`` exactly when its first ``p``
bits are the block's. So the range lookup is an equality join on ``(p, bits)``,
tried for each prefix length in use (at most 129, in practice some thirty): no
range condition, no comparison of all pairs within a bucket, no wide range blown
up into many buckets. No broadcast is forced: Spark broadcasts the blocks when
their measured size allows and shuffles otherwise, where adaptive execution
splits a network that holds very many of the addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.addresses import (
    address_sql,
    is_v4,
    network_sql,
    parse_address,
    with_address,
)
from vigilog.session import staged

# Fixed value: the answer for a bad address or one outside every block.
UNKNOWN = "Unknown"

V4_BITS = 96

#: A prefix length that no block has.
NO_BLOCK = -2


def blocks_from_networks(networks: DataFrame) -> DataFrame:
    """Blocks of ``networks(network, city, country)``, e.g. ``10.0.0.0/8``."""
    split = networks.select(
        F.substring_index("network", "/", 1).alias("base"),
        F.substring_index("network", "/", -1).cast("int").alias("bits"),
        "city",
        "country",
    )
    located = split.select(
        parse_address("base").alias("a"),
        (F.col("bits") + F.when(F.col("base").contains(":"), 0).otherwise(V4_BITS)).alias("plen"),
        "city",
        "country",
    ).filter("a is not null")
    high, low = network_sql("a.hi", "a.lo", "plen")
    # Declared never null, else the null test of every join key repeats the parse.
    return located.select(
        F.coalesce(F.col("plen").cast("int"), F.lit(-1)).alias("plen"),
        F.coalesce(F.expr(high), F.lit(0)).alias("hi"),
        F.coalesce(F.expr(low), F.lit(0)).alias("lo"),
        "city",
        "country",
    )


def blocks_from_ranges(ranges: DataFrame) -> DataFrame:
    """Blocks of IPv4 ``ranges(lo, hi, city, country)``, both ends included.

    Each range falls apart into the fewest aligned blocks: sizes grow while the
    start allows it, then shrink towards the end. That is at most 62 per range.
    """
    cover = F.expr(
        """
        aggregate(sequence(0, 64),
          named_struct('at', lo,
                       'cut', cast(array() AS array<struct<start: bigint, k: int>>)),
          (acc, i) -> named_struct(
            'at', acc.at + CASE WHEN
                acc.at + shiftleft(1L, least(i, 64 - i)) <= hi + 1
                AND (i >= 32 OR (acc.at & shiftleft(1L, i)) <> 0)
              THEN shiftleft(1L, least(i, 64 - i)) ELSE 0L END,
            'cut', CASE WHEN
                acc.at + shiftleft(1L, least(i, 64 - i)) <= hi + 1
                AND (i >= 32 OR (acc.at & shiftleft(1L, i)) <> 0)
              THEN concat(acc.cut,
                array(named_struct('start', acc.at, 'k', least(i, 64 - i))))
              ELSE acc.cut END),
          acc -> acc.cut)
        """
    )
    return ranges.select(F.explode(cover).alias("c"), "city", "country").select(
        (F.lit(128) - F.col("c.k")).cast("int").alias("plen"),
        F.lit(0).cast("bigint").alias("hi"),
        (F.col("c.start") + F.lit(0xFFFF << 32)).alias("lo"),
        "city",
        "country",
    )


def read_blocks(spark: SparkSession, networks_csv: str, names_csv: str) -> DataFrame:
    """Blocks of an address database in its public CSV form: a network file with
    ``network, geoname_id`` and a names file with ``geoname_id, city_name,
    country_name``."""
    networks = spark.read.option("header", "true").csv(networks_csv)
    names = spark.read.option("header", "true").csv(names_csv)
    return blocks_from_networks(
        networks.join(names, "geoname_id", "left").select(
            "network",
            F.col("city_name").alias("city"),
            F.col("country_name").alias("country"),
        )
    )


def prefix_lengths(blocks: DataFrame) -> dict[str, list[int]]:
    """Prefix lengths in use, per address family; 129 values at the very most."""
    used = blocks.select("plen", F.expr(is_v4()).alias("v4")).distinct().collect()
    return {
        "v4": sorted(r.plen for r in used if r.v4),
        "v6": sorted(r.plen for r in used if not r.v4),
    }


def _candidates_sql(hi: str, lo: str, lengths: dict[str, list[int]]) -> str:
    """Array of the networks an address may be found under."""

    def one(p: int) -> str:
        high, low = network_sql(hi, lo, p)
        return f"named_struct('plen', {p}, 'hi', {high}, 'lo', {low})"

    def some(family: str) -> str:
        listed = ", ".join(one(p) for p in lengths[family])
        return f"array({listed})" if listed else (
            "cast(NULL AS array<struct<plen: int, hi: bigint, lo: bigint>>)"
        )

    return f"CASE WHEN {is_v4(hi, lo)} THEN {some('v4')} ELSE {some('v6')} END"


def geo_lookup(
    rows: DataFrame, column: str, blocks: DataFrame, lengths: dict[str, list[int]] | None = None
) -> DataFrame:
    """Adds ``city`` and ``country`` of the address in ``column``.

    ``rows`` must be distinct. A bad or uncovered address gives ``Unknown``; a
    block without a name gives null.
    """
    return with_places(with_address(rows, column), blocks, lengths).drop("_hi", "_lo")


def with_places(
    rows: DataFrame, blocks: DataFrame, lengths: dict[str, list[int]] | None = None
) -> DataFrame:
    """The same for rows that have their address parsed, as ``_hi`` and ``_lo``.

    One pass: candidates are expanded, joined, and folded back on the columns of
    the rows, whose partitioning still holds when the blocks were broadcast.
    """
    lengths = lengths or prefix_lengths(blocks)
    keys = rows.columns
    candidates = F.expr(
        f"CASE WHEN _hi IS NOT NULL THEN {_candidates_sql('_hi', '_lo', lengths)} END"
    )
    # Rows with nothing to look up get a key that matches no block and spreads them.
    nothing = F.struct(
        F.lit(NO_BLOCK).alias("plen"),
        F.xxhash64(*keys).alias("hi"),
        F.lit(0).cast("bigint").alias("lo"),
    )
    expanded = rows.select(
        *keys, F.explode(F.coalesce(candidates, F.array(nothing))).alias("_c")
    )
    found = expanded.join(
        blocks.select(
            F.col("plen").alias("_bplen"),
            F.col("hi").alias("_bhi"),
            F.col("lo").alias("_blo"),
            F.struct("city", "country").alias("_place"),
        ),
        (F.col("_c.plen") == F.col("_bplen"))
        & (F.col("_c.hi") == F.col("_bhi"))
        & (F.col("_c.lo") == F.col("_blo")),
        "left",
    )
    # Of overlapping networks the longest prefix names the place.
    longest = F.max(F.when(F.col("_bplen").isNotNull(), F.struct("_bplen", "_place")))
    place = found.groupBy(*keys).agg(longest["_place"].alias("_place"))
    return place.select(*keys, _named("city"), _named("country"))


def _named(part: str) -> Column:
    return (
        F.when(F.col("_place").isNull(), UNKNOWN).otherwise(F.col(f"_place.{part}")).alias(part)
    )


def register_geo_functions(
    spark: SparkSession, blocks: DataFrame, view: str = "geo_blocks", addresses: DataFrame | None = None
) -> None:
    """SQL functions ``city(ip)`` and ``country(ip)``, and ``place(ip)`` with both as a struct.

    They are SQL functions over a view, so Catalyst plans each use as a join: no Python, nothing collected. Without
    ``addresses`` each use looks its addresses up in the blocks. ``addresses``, one column, names the addresses
    that will be asked for, such as those of the queried table: each distinct one is looked up once and kept
    as a table, and a use is one equality join with it. Any other address is then ``Unknown``.
    """
    if addresses is not None:
        _register_known(spark, blocks, addresses, f"{view}_known")
        return
    blocks.createOrReplaceTempView(view)
    lengths = prefix_lengths(blocks)
    candidates = f"CASE WHEN s.a IS NOT NULL THEN {_candidates_sql('s.a.hi', 's.a.lo', lengths)} END"
    longest = "max(named_struct('p', g.plen, 'city', g.city, 'country', g.country))"

    def lookup(answer: str, unknown: str) -> str:
        return f"""
              SELECT CASE WHEN count(g.plen) = 0 THEN {unknown} ELSE {answer} END
              FROM (
                SELECT explode({candidates}) AS c
                FROM (SELECT {address_sql('ip')} AS a) s
              ) k
              JOIN {view} g ON g.plen = k.c.plen AND g.hi = k.c.hi AND g.lo = k.c.lo"""

    for name in ("city", "country"):
        _create(spark, name, "STRING", lookup(f"{longest}.{name}", f"'{UNKNOWN}'"))
    both = f"named_struct('city', {longest}.city, 'country', {longest}.country)"
    _create(spark, "place", PLACE, lookup(both, _UNKNOWN_PLACE))


PLACE = "STRUCT<city STRING, country STRING>"
_UNKNOWN_PLACE = f"named_struct('city', '{UNKNOWN}', 'country', '{UNKNOWN}')"


def _create(spark: SparkSession, name: str, kind: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(ip STRING) RETURNS {kind} RETURN ({body})")


def _register_known(spark: SparkSession, blocks: DataFrame, addresses: DataFrame, view: str) -> None:
    column = addresses.columns[0]
    asked = addresses.select(F.col(column).cast("string").alias("ip")).filter("ip is not null").distinct()
    # Without a column of the parameter's name.
    places = geo_lookup(asked, "ip", blocks).withColumnRenamed("ip", "known_ip")
    staged(places, "places").createOrReplaceTempView(view)

    def known(answer: str, unknown: str) -> str:
        return f"SELECT CASE WHEN count(1) = 0 THEN {unknown} ELSE {answer} END FROM {view} k WHERE k.known_ip = ip"

    for name in ("city", "country"):
        _create(spark, name, "STRING", known(f"max(k.{name})", f"'{UNKNOWN}'"))
    _create(spark, "place", PLACE, known("max(named_struct('city', k.city, 'country', k.country))", _UNKNOWN_PLACE))
