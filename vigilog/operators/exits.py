"""Membership of an address in the exit-node list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.addresses import with_address


def _keyed(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("hi").alias("_nhi"), F.col("lo").alias("_nlo"))


def _same() -> Column:
    return (F.col("_hi") == F.col("_nhi")) & (F.col("_lo") == F.col("_nlo"))


def from_exit_nodes(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The rows whose address is an exit node, by value and not by spelling."""
    return (
        with_address(rows, column)
        .join(_keyed(nodes), _same(), "left_semi")
        .select(*rows.columns)
    )


def with_exit_flag(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """Adds ``is_exit``, false for bad addresses and for an empty list."""
    return with_flags(with_address(rows, column), nodes).drop("_hi", "_lo")


def with_flags(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for rows that have their address parsed, as ``_hi`` and ``_lo``.

    Rows without an address match nothing; their key spreads them.
    """
    same = (
        (F.coalesce("_hi", F.xxhash64(*rows.columns)) == F.col("_nhi"))
        & (F.coalesce("_lo", F.lit(-1)) == F.col("_nlo"))
        & F.col("_hi").isNotNull()
    )
    return rows.join(_keyed(nodes).withColumn("_exit", F.lit(True)), same, "left").select(
        *rows.columns, F.coalesce("_exit", F.lit(False)).alias("is_exit")
    )
