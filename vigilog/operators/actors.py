"""Profilers over whole events: who acted from which address, and use of the root account.

An exit node in use by one principal is one finding, however often it shows. So sightings carry their actor and are
reported once per actor and address, in the first batch that shows the pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions.deep_json import with_deep_values
from vigilog.operators.exits import from_exit_nodes
from vigilog.operators.profilers import PRINCIPAL_ID, SOURCE_IP_ADDRESS
from vigilog.sources.audit import typed_events


def actor_addresses(events: DataFrame, *carry: str) -> DataFrame:
    """``(actor, address)`` of each event: each address with each principal that the event names, once per event.

    An event that names no principal has a null actor; one without an address gives no row.
    """
    found = with_deep_values(events.select(*carry, "event_json"), [PRINCIPAL_ID, SOURCE_IP_ADDRESS])

    def of(field: str):
        chosen = F.filter("pairs", lambda p: p["field"] == field)
        return F.transform(chosen, lambda p: p["value"])

    # Outer, like in field_values, so that no test for emptiness is pushed down with the function.
    addressed = found.select(*carry, of(PRINCIPAL_ID).alias("actors"), F.explode_outer(of(SOURCE_IP_ADDRESS)).alias("address"))
    return addressed.select(*carry, F.explode_outer("actors").alias("actor"), "address").filter("address is not null")


def sighted_actors(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(batch_id, actor, address)``: exit nodes in use, once per actor, in the first batch that shows them.

    ``events`` need ``batch_id``. Pairs are reduced to their first batch before they meet the list.
    """
    pairs = actor_addresses(events, "batch_id").groupBy("actor", "address").agg(F.min("batch_id").alias("batch_id"))
    return from_exit_nodes(pairs, "address", nodes).select("batch_id", "actor", "address")


def root_uses(events: DataFrame, *carry: str) -> DataFrame:
    """``(event_id, event_source, event_name, account)`` of the events that an account's root made.

    The principal of root is the account itself. Needs no state, so it runs alike over history and on a stream.
    """
    typed = typed_events(events, *carry).filter("userIdentity.principalId = userIdentity.accountId")
    return typed.select(
        *carry,
        F.col("eventID").alias("event_id"),
        F.col("eventSource").alias("event_source"),
        F.col("eventName").alias("event_name"),
        F.col("userIdentity.accountId").alias("account"),
    )
