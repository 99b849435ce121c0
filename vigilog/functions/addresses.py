"""Address text to comparable numbers, all inside the JVM.

Every address is a point in one 128-bit space, held as two signed 64-bit halves
``hi`` and ``lo``. An IPv4 address takes its IPv4-mapped place, so a mapped IPv6
literal equals the plain IPv4 one. Only literals count: a host name, or any
other text, gives null.

Expressions are SQL text, since the SQL functions of :mod:`vigilog.operators.geo`
need them in that form; ``{a}`` stands for the argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The top half-word of the IPv4-mapped range ::ffff:0:0/96, and
# the longest text the dotted form may have.
V4_BASE = 0xFFFF << 32
V4_MAX_CHARS = 15

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
QUAD = f"^{_OCTET}(?:[.]{_OCTET}){{3}}$"
PARTS = "^[0-9]+(?:[.][0-9]+){0,3}$"


def v4_sql(a: str) -> str:
    """Dotted decimal to bigint. One to four parts; the last fills the rest."""
    # Plain quads first: nearly all text, and one pattern checks them whole.
    return (
        f"CASE WHEN {a} RLIKE '{QUAD}' THEN "
        f"aggregate(split({a}, '[.]'), 0L, (v, p) -> v * 256 + cast(p AS bigint)) "
        f"WHEN {a} RLIKE '{PARTS}' AND length({a}) <= {V4_MAX_CHARS} THEN {_v4_parts_sql(a)} END"
    )


def _v4_parts_sql(a: str) -> str:
    branches = []
    for n in (4, 3, 2, 1):
        room = 1 << (8 * (5 - n))
        fits = [f"get(p, {i}) < 256" for i in range(n - 1)] + [f"get(p, {n - 1}) < {room}"]
        total = " + ".join(
            [f"get(p, {i}) * {1 << (24 - 8 * i)}" for i in range(n - 1)] + [f"get(p, {n - 1})"]
        )
        branches.append(f"WHEN size(p) = {n} AND {' AND '.join(fits)} THEN {total}")
    parts = f"transform(split({a}, '[.]'), x -> cast(x AS bigint))"
    return _let(parts, "p", f"CASE {' '.join(branches)} END")


def _v6_text_sql(a: str) -> str:
    """IPv6 text without brackets or numeric zone, a dotted tail written in hex."""
    bare = (
        f"regexp_replace(regexp_replace({a}, '^[\\\\[](.*)[\\\\]]$', '$1'), '%[0-9]+$', '')"
    )
    tail = f"substring_index({bare}, ':', -1)"
    v4 = v4_sql(tail)
    return (
        f"CASE WHEN {tail} RLIKE '^[0-9]+([.][0-9]+){{3}}$' THEN concat("
        f"left({bare}, length({bare}) - length({tail})), "
        f"lower(hex(shiftright({v4}, 16))), ':', lower(hex({v4} & 65535))) ELSE {bare} END"
    )


def _v6_hex_sql(t: str) -> str:
    """32 hex digits of IPv6 text ``t``, or null when it is malformed."""
    h = "[0-9a-fA-F]{1,4}"
    groups = "CASE WHEN {x} = '' THEN array() ELSE split({x}, ':') END"
    left = groups.format(x=f"substring_index({t}, '::', 1)")
    right = groups.format(x=f"substring_index({t}, '::', -1)")
    zeros = f"array_repeat('0', 8 - size({left}) - size({right}))"
    pad = "g -> lpad(g, 4, '0')"
    return (
        f"CASE WHEN {t} RLIKE '^{h}(:{h}){{7}}$' "
        f"THEN array_join(transform(split({t}, ':'), {pad}), '') "
        f"WHEN {t} RLIKE '^({h}(:{h})*)?::({h}(:{h})*)?$' "
        f"AND size({left}) + size({right}) <= 7 "
        f"THEN array_join(transform(concat({left}, {zeros}, {right}), {pad}), '') END"
    )


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once.

    A one-element array does the binding. Without it every mention of the
    argument would repeat whatever expression stands behind it.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def address_sql(a: str) -> str:
    """Struct ``(hi, lo)`` of address text, or null."""
    v6 = _let(
        _let(_v6_text_sql("s"), "t", _v6_hex_sql("t")),
        "d",
        "CASE WHEN d IS NOT NULL THEN named_struct("
        "'hi', cast(conv(left(d, 16), 16, -10) AS bigint), "
        "'lo', cast(conv(right(d, 16), 16, -10) AS bigint)) END",
    )
    v4 = _let(
        v4_sql("s"),
        "v",
        f"CASE WHEN v IS NOT NULL THEN named_struct('hi', 0L, 'lo', v + {V4_BASE}L) END",
    )
    return _let(a, "s", f"CASE WHEN s LIKE '%:%' THEN {v6} ELSE {v4} END")


def parse_address(column: str) -> Column:
    """``(hi, lo)`` of the address text in the named column."""
    return F.expr(address_sql(f"`{column}`"))


def ip_to_long(column: str) -> Column:
    """IPv4 value of the address text (mapped IPv6 included), else null."""
    value = f"CASE WHEN {is_v4('a.hi', 'a.lo')} THEN a.lo - {V4_BASE}L END"
    return F.expr(_let(address_sql(f"`{column}`"), "a", value))


def with_address(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``_hi`` and ``_lo`` of an address, both null when it is none.

    They come out of a generator: a test of the join key then stays above it,
    where a projection would have the parse repeated inside a pushed-down filter.
    """
    return rows.select("*", F.inline(F.array(parse_address(column))).alias("_hi", "_lo"))


def is_v4(hi: str = "hi", lo: str = "lo") -> str:
    """SQL test for a point of the IPv4-mapped range."""
    return f"({hi} = 0 AND shiftright({lo}, 32) = 65535)"


def network_sql(hi: str, lo: str, plen: int | str) -> tuple[str, str]:
    """Halves of the point with all but its first ``plen`` bits cleared."""
    if isinstance(plen, int):
        high = hi if plen >= 64 else "0L" if plen == 0 else _keep(hi, 64 - plen)
        low = "0L" if plen <= 64 else lo if plen == 128 else _keep(lo, 128 - plen)
        return high, low
    return (
        f"CASE WHEN {plen} >= 64 THEN {hi} WHEN {plen} = 0 THEN 0L "
        f"ELSE {_keep(hi, f'(64 - {plen})')} END",
        f"CASE WHEN {plen} <= 64 THEN 0L WHEN {plen} = 128 THEN {lo} "
        f"ELSE {_keep(lo, f'(128 - {plen})')} END",
    )


def _keep(half: str, cleared: int | str) -> str:
    return f"shiftleft(shiftright({half}, {cleared}), {cleared})"
