"""From log objects to tables and views for any SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.sources.access import access_rejects, parse_access_lines, read_access_lines
from vigilog.sources.audit import (
    inferred_events,
    line_rejects,
    read_lines,
    typed_events,
    typed_records,
    unnest_records,
    variant_events,
)

# The table names users query.
AUDIT_TABLE = "cloudtrail"
ACCESS_TABLE = "s3logs"
SAVED_SUFFIX = "hive"


def audit_events(
    spark: SparkSession,
    paths: str | list[str],
    tolerant: bool = False,
    infer: bool = False,
    keep_text: bool = False,
    keep_variant: bool = False,
) -> DataFrame:
    """The events of all audit-log objects below the paths, as columns.

    ``keep_text`` adds the original ``event_json``, ``keep_variant`` the event as a VARIANT column ``event``,
    which SQL reads by path; ``infer`` takes the columns from the data instead of the fixed schema.
    """
    lines = read_lines(spark, paths, tolerant)
    if keep_variant:
        return variant_events(unnest_records(lines))
    if infer:
        return inferred_events(unnest_records(lines))
    return typed_events(unnest_records(lines)) if keep_text else typed_records(lines)


def register(table: DataFrame, view: str, cache: bool = False) -> DataFrame:
    """Names the table for SQL, and keeps it at hand on request.

    Caching spills to disk. At scale prefer the saved table: its columnar files
    give column pruning and filter pushdown, which cached text cannot.
    """
    if cache:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
    table.createOrReplaceTempView(view)
    return table


def save_table(
    table: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None
) -> DataFrame:
    """Writes a Parquet table, failing when it exists, and returns it as read back."""
    writer = table.write.format("parquet").mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return table.sparkSession.table(name)


def write_rejects(rejects: DataFrame, path: str | None) -> None:
    """Adds the rejected lines to a table, where the caller names one: a pass of its own."""
    if path:
        rejects.write.mode("append").parquet(path)


def create_audit_table(
    spark: SparkSession,
    paths: str | list[str],
    infer: bool = False,
    cache: bool = True,
    rejects: str | None = None,
    keep_variant: bool = False,
) -> DataFrame:
    write_rejects(line_rejects(read_lines(spark, paths)), rejects)
    return register(audit_events(spark, paths, infer=infer, keep_variant=keep_variant), AUDIT_TABLE, cache)


def with_event_date(events: DataFrame) -> DataFrame:
    """Adds ``event_date``, the day of the event time, to partition tables by."""
    return events.withColumn("event_date", F.to_date(F.substring("eventTime", 1, 10)))


def create_audit_saved_table(
    spark: SparkSession,
    paths: str | list[str],
    path: str | None = None,
    by_date: bool = False,
    rejects: str | None = None,
) -> DataFrame:
    write_rejects(line_rejects(read_lines(spark, paths)), rejects)
    events = audit_events(spark, paths)
    if by_date:
        return save_table(
            with_event_date(events), AUDIT_TABLE + SAVED_SUFFIX, path, ["event_date"]
        )
    return save_table(events, AUDIT_TABLE + SAVED_SUFFIX, path)


def create_access_table(
    spark: SparkSession, path: str, cache: bool = True, rejects: str | None = None
) -> DataFrame:
    lines = read_access_lines(spark, path)
    write_rejects(access_rejects(lines), rejects)
    return register(parse_access_lines(lines), ACCESS_TABLE, cache)


def create_access_saved_table(
    spark: SparkSession,
    path: str,
    table_path: str | None = None,
    rejects: str | None = None,
    name: str = ACCESS_TABLE + SAVED_SUFFIX,
) -> DataFrame:
    lines = read_access_lines(spark, path)
    write_rejects(access_rejects(lines), rejects)
    return save_table(parse_access_lines(lines), name, table_path)
