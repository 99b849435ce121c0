"""What is profiled: observations of named fields, and the profilers over them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.addresses import with_address
from vigilog.functions.deep_json import with_deep_values
from vigilog.operators.exits import with_flags
from vigilog.operators.geo import UNKNOWN, with_places

DEVIATION = "deviation"
SIGHTING = "tor"

#: Columns that lookups add to an address.
LOOKUPS = ("city", "country", "is_exit")

# The profiled fields, the names of the profilers, and the mark
# of a temporary access key.
SOURCE_IP_ADDRESS = "sourceIPAddress"
ACCESS_KEY_ID = "accessKeyId"
PRINCIPAL_ID = "principalId"
PRINCIPAL_ARN = "arn"
CITY_PROFILER = "SourceIP-City"
COUNTRY_PROFILER = "SourceIP-Country"
EXIT_PROFILER = "SourceIP-TorExitNode"
TEMPORARY_KEY_PREFIX = "ASIA"


@dataclass(frozen=True)
class Profiler:
    """One profile over one field.

    ``value`` and ``keep`` are SQL expressions over an observation: ``value``
    itself, and for addresses ``city``, ``country`` and ``is_exit``. ``enrich``
    may add further columns, say by a join; it must keep one row per observation.
    A ``deviation`` profiler alerts when a batch shows values its profile lacks;
    a ``tor`` profiler keeps no profile and reports every value, every batch.
    """

    name: str
    field: str
    value: str = "value"
    keep: str = "true"
    kind: str = DEVIATION
    enrich: Callable[[DataFrame], DataFrame] | None = None

    @property
    def needs_lookup(self) -> bool:
        """Whether more than the observed value decides what is kept."""
        return self.enrich is not None or self.uses(*LOOKUPS)

    @property
    def keeps_value(self) -> bool:
        """Whether a profile value is the observed value itself, kept or not for good.

        Where a lookup decides, a value seen before may yet be new to the profile.
        """
        return self.value == "value" and not self.needs_lookup

    def uses(self, *columns: str) -> bool:
        """Whether the expressions name any of the columns; words in text literals do not count."""
        code = re.sub(r"'(?:[^'\\]|\\.|'')*'", "", f"{self.value} {self.keep}")
        return any(re.search(rf"\b{c}\b", code) for c in columns)


ACCESS_KEY_PROFILER = Profiler(
    ACCESS_KEY_ID, ACCESS_KEY_ID, keep=f"NOT startswith(value, '{TEMPORARY_KEY_PREFIX}')"
)
ARN_PROFILER = Profiler(PRINCIPAL_ARN, PRINCIPAL_ARN)
GEO_CITY_PROFILER = Profiler(CITY_PROFILER, SOURCE_IP_ADDRESS, value="city")
GEO_COUNTRY_PROFILER = Profiler(COUNTRY_PROFILER, SOURCE_IP_ADDRESS, value="country")
TOR_PROFILER = Profiler(EXIT_PROFILER, SOURCE_IP_ADDRESS, keep="is_exit", kind=SIGHTING)
PRINCIPAL_PROFILER = Profiler(PRINCIPAL_ID, PRINCIPAL_ID)
SOURCE_IP_PROFILER = Profiler(SOURCE_IP_ADDRESS, SOURCE_IP_ADDRESS)

DEFAULT_PROFILERS = [
    ACCESS_KEY_PROFILER,
    ARN_PROFILER,
    GEO_CITY_PROFILER,
    GEO_COUNTRY_PROFILER,
    TOR_PROFILER,
]


def profiled_fields(profilers: list[Profiler]) -> list[str]:
    return sorted({p.field for p in profilers})


def field_values(events: DataFrame, fields: list[str], *carry: str) -> DataFrame:
    """``(field, value)`` of each event, each pair once per event."""
    # An inner explode would add a pushed-down test for emptiness, and with it a
    # second run of the function.
    return (
        with_deep_values(events.select(*carry, "event_json"), fields)
        .select(*carry, F.explode_outer("pairs").alias("p"))
        .select(*carry, "p.field", "p.value")
        .filter("field is not null")
    )


def observations(events: DataFrame, fields: list[str]) -> DataFrame:
    """``(batch_id, field, value)``, each once per batch."""
    return field_values(events, fields, "batch_id").distinct()


def wanted(rows: DataFrame, profilers: list[Profiler]) -> DataFrame:
    """Without the ``(field, value)`` rows that no profiler keeps, whatever a lookup says."""
    kept = [f"(field = '{p.field}' AND ({'true' if p.needs_lookup else p.keep}))" for p in profilers]
    return rows.filter(" OR ".join(kept))


def enriched(
    observed: DataFrame,
    profilers: list[Profiler],
    blocks: DataFrame | None = None,
    nodes: DataFrame | None = None,
    lengths: dict[str, list[int]] | None = None,
) -> DataFrame:
    """Adds the columns the profilers ask for. ``observed`` must be distinct.

    Addresses are parsed once, and both lookups run in the same pass over the
    observations, whatever the number of profilers that need them.
    """
    places = any(p.uses("city", "country") for p in profilers)
    exits = any(p.uses("is_exit") for p in profilers)
    if places and blocks is None:
        raise ValueError("a profiler needs city or country, but no blocks were given")
    if exits and nodes is None:
        raise ValueError("a profiler needs is_exit, but no exit nodes were given")
    if places or exits:
        address = F.when(F.col("field") == SOURCE_IP_ADDRESS, F.col("value"))
        observed = with_address(observed.withColumn("_ip", address), "_ip").drop("_ip")
        if places:
            observed = with_places(observed, blocks, lengths)
        if exits:
            observed = with_flags(observed, nodes)
        observed = observed.drop("_hi", "_lo")
    for step in dict.fromkeys(p.enrich for p in profilers if p.enrich):
        observed = step(observed)
    return observed


def expanded(observed: DataFrame, profilers: list[Profiler], *carry: str) -> DataFrame:
    """``(profiler, kind, value)`` of each observation, for each of its profilers.

    The profilers are few and known, so they expand in place: one pass, no join.
    An observation of a field nobody profiles disappears.
    """
    per_profiler = ", ".join(
        f"CASE WHEN field = '{p.field}' AND ({p.keep}) THEN named_struct("
        f"'profiler', '{p.name}', 'kind', '{p.kind}', 'value', cast({p.value} AS string)) END"
        for p in profilers
    )
    return observed.select(
        *carry, F.explode(F.expr(f"array_compact(array({per_profiler}))")).alias("p")
    ).select(*carry, "p.profiler", "p.kind", "p.value")


def with_places_once(
    observed: DataFrame,
    profilers: list[Profiler],
    blocks: DataFrame | None,
    nodes: DataFrame | None,
) -> DataFrame:
    """The columns of :func:`enriched` for observations of many batches.

    Each address is looked up once, in however many batches it shows, and rows
    without an address stay out of the joins. ``observed`` is read three times.
    """
    bare = [replace(p, enrich=None) for p in profilers]
    is_address = F.col("field") == SOURCE_IP_ADDRESS
    addresses = observed.filter(is_address)
    found = enriched(addresses.select("field", "value").distinct(), bare, blocks, nodes)
    added = found.columns[2:]
    found = found.select(F.col("value").alias("_v"), *added)
    with_address_columns = addresses.join(found, F.col("value").eqNullSafe(F.col("_v"))).drop("_v")
    none = {"city": F.lit(UNKNOWN), "country": F.lit(UNKNOWN), "is_exit": F.lit(False)}
    others = observed.filter(~is_address).select("*", *[none[c].alias(c) for c in added])
    rows = with_address_columns.unionByName(others)
    for step in dict.fromkeys(p.enrich for p in profilers if p.enrich):
        rows = step(rows)
    return rows


def candidates(
    observed: DataFrame,
    profilers: list[Profiler],
    blocks: DataFrame | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """``(profiler, kind, batch_id, value)``: what each profiler saw in each batch, once.

    Profilers of places read ``observed`` several times, so hand it over as a table.
    """
    places = blocks is not None and any(p.uses("city", "country") for p in profilers)
    look_up = with_places_once if places else enriched
    rows = look_up(wanted(observed, profilers), profilers, blocks, nodes)
    return expanded(rows, profilers, "batch_id").distinct()
