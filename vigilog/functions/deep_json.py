"""All values of named keys at any depth of a JSON text.

A member whose key matches gives its value as text and its inside is not
searched for that key again; everything else is searched. Strings read as they
are, numbers and booleans in canonical text, null as ``null``, an object or
array as the empty string. Keys compare case-sensitively.

Spark has no expression for this: a regular expression cannot tell what a match
hides, and un-nesting level by level needs a known depth. So the text column,
and nothing else, goes to Python in Arrow batches and is parsed once for all
keys. A native path that proves the cheap cases cheap (validity, repeated keys,
plain values) was measured and lost, on 600,000 events of 800 bytes.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions travel whole to the executors, which need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CONTAINERS = (dict, list)
_PAIRS = "array<struct<field: string, value: string>>"


def _number_text(value: float) -> str:
    """A double the way the JVM prints it: 1.0E10, 0.001, 12.5."""
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return str(value)
    exact = Decimal(repr(value)).normalize()
    exponent = exact.adjusted()
    if -3 <= exponent < 7:
        text = f"{exact:f}"
        return text if "." in text else f"{text}.0"
    first, *rest = map(str, exact.as_tuple().digits)
    return f"{'-' if value < 0 else ''}{first}.{''.join(rest) or '0'}E{exponent}"


def _as_text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, float):
        return _number_text(value)
    return "" if isinstance(value, (dict, list)) else str(value)


def _reject_constant(name: str) -> None:
    raise ValueError(name)


def find_values(text: str, fields: frozenset[str]) -> list[tuple[str, str]] | None:
    """(field, value) pairs of one text, repeats included; None when it is not JSON."""
    try:
        pending = [(json.loads(text, parse_constant=_reject_constant), fields)]
    except (ValueError, RecursionError):
        return None
    found = []
    while pending:
        node, wanted = pending.pop()
        if type(node) is dict:
            for key, value in node.items():
                inner = type(value) in _CONTAINERS
                if key in wanted:
                    found.append((key, value if type(value) is str else _as_text(value)))
                    if inner and len(wanted) > 1:
                        pending.append((value, wanted - {key}))
                elif inner:
                    pending.append((value, wanted))
        elif type(node) is list:
            pending.extend((n, wanted) for n in node if type(n) in _CONTAINERS)
    return found


def _pairs_array(texts: pa.Array, names: frozenset[str]) -> pa.Array:
    """The pairs of a batch as one Arrow list array, built from flat columns."""
    ends: list[int | None] = []
    fields: list[str] = []
    values: list[str] = []
    for text in texts.to_pylist():
        found = None if text is None else find_values(text, names)
        ends.append(None if found is None else len(fields))
        for field, value in found or ():
            fields.append(field)
            values.append(value)
    ends.append(len(fields))
    pairs = pa.StructArray.from_arrays(
        [pa.array(fields, pa.string()), pa.array(values, pa.string())], ["field", "value"]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def all_values(column: Column, fields: list[str]) -> Column:
    """Every (field, value) pair of each text; null where the text is not JSON."""
    names = frozenset(fields)

    @F.arrow_udf(_PAIRS)
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _pairs_array(texts, names)

    return walk(column)


def with_deep_values(events: DataFrame, fields: list[str], text: str = "event_json") -> DataFrame:
    """Adds ``pairs``, the distinct (field, value) pairs of each event."""
    return events.withColumn(
        "pairs", F.array_distinct(all_values(F.col(text), sorted(set(fields))))
    )
