"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.addresses import ip_to_long, parse_address
from vigilog.functions.text import joined
from vigilog.operators import profilers as P
from vigilog.operators import profiles
from vigilog.operators.alerts import (
    deviation_messages,
    deviation_subject,
    listed,
    sighting_messages,
)
from vigilog.operators.exits import from_exit_nodes, with_exit_flag
from vigilog.operators import expiry
from vigilog.operators.actors import root_uses, sighted_actors
from vigilog.operators.frequency import frequencies, frequency_alerts
from vigilog.operators.geo import geo_lookup, read_blocks, register_geo_functions
from vigilog.plans import fixtures
from vigilog.plans.tables import (
    ACCESS_TABLE,
    AUDIT_TABLE,
    create_access_saved_table,
    register,
    save_table,
)
from vigilog.session import run_folder, staged
from vigilog.sources import access, audit, notifications
from vigilog.sources.exit_nodes import exit_node_rejects
from vigilog.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]

# The SQL that ships with the library.
PRINCIPALS_SQL = """
    select distinct userIdentity.principalId, sourceIPAddress, userIdentity.accessKeyId
    from cloudtrail order by accessKeyId"""
ROOT_USAGE_SQL = """
    select distinct eventSource, eventName, userIdentity.principalId
    from cloudtrail where userIdentity.principalId = userIdentity.accountId"""
GEO_SQL = """
    select distinct sourceIpAddress, city(sourceIpAddress) as city,
           country(sourceIpAddress) as country
    from cloudtrail"""
ACCESS_IP_SQL = "select distinct ip from s3logs"


# --- audit logs to SQL -------------------------------------------------------


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``cloudtrail``, from log lines through to columns."""
    lines = fixtures.event_lines(spark, sf_dir)
    return register(audit.typed_records(lines), AUDIT_TABLE)


def audit_distinct_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit_view(spark, sf_dir)
    return spark.sql(PRINCIPALS_SQL)


def audit_root_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit_view(spark, sf_dir)
    return spark.sql(ROOT_USAGE_SQL)


def audit_geo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = audit_view(spark, sf_dir).select("sourceIPAddress").distinct()
    return geo_lookup(addresses, "sourceIPAddress", fixtures.geo_blocks(spark, sf_dir))


def audit_geo_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = audit_view(spark, sf_dir).select("sourceIPAddress")
    register_geo_functions(spark, fixtures.geo_blocks(spark, sf_dir), addresses=addresses)
    return spark.sql(GEO_SQL)


def audit_place_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and country by one function, looked up where it is used."""
    audit_view(spark, sf_dir)
    register_geo_functions(spark, fixtures.geo_blocks(spark, sf_dir))
    return spark.sql(
        "select a as sourceIpAddress, p.city, p.country from (select a, place(a) as p from "
        "(select distinct sourceIpAddress as a from cloudtrail))"
    )


def net_geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by an address database in its CSV form: many lengths, overlaps, IPv6."""
    folder = run_folder(spark, "networks")
    fixtures.network_rows(spark, sf_dir).write.option("header", "true").csv(f"{folder}/networks")
    fixtures.network_names(spark, sf_dir).write.option("header", "true").csv(f"{folder}/names")
    blocks = staged(read_blocks(spark, f"{folder}/networks", f"{folder}/names"), "blocks")
    return geo_lookup(fixtures.address_texts(spark, sf_dir).distinct(), "ip", blocks)


def audit_source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_catalogue(fixtures.log_sources(spark, sf_dir))


def audit_object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = fixtures.log_sources(spark, sf_dir)
    return audit.objects_of_sources(fixtures.object_listing(spark, sf_dir), sources)


def audit_unnest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unnest_records(fixtures.audit_lines(spark, sf_dir))


def audit_unnest_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unnest_all_fields(fixtures.mixed_lines(spark, sf_dir))


def audit_variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no schema names, read by path from SQL beside typed columns."""
    events = fixtures.deep_events(spark, sf_dir)
    register(audit.variant_events(events, "event_id"), AUDIT_TABLE)
    return spark.sql(
        """select event_id, userIdentity.arn as identity_arn,
                  variant_get(event, '$.q.w[0][0].accessKeyId', 'string') as deep_key,
                  variant_get(event, '$.z.arn', 'string') as z_arn,
                  variant_get(event, '$.list[0]', 'string') as listed,
                  variant_get(event, '$.note', 'string') as note,
                  schema_of_variant(variant_get(event, '$.arn', 'variant')) as arn_type
           from cloudtrail"""
    )


def audit_inferred_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields as columns, by inference over all events."""
    events = audit.inferred_events(fixtures.deep_events(spark, sf_dir).select("event_json"))
    return events.selectExpr(
        "userIdentity.arn AS identity_arn", "q.w[0][0].accessKeyId AS deep_key", "z.arn AS z_arn",
        "list[0] AS listed", "note", "get(resources, 1).arn AS second_resource",
    )


def audit_line_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.line_rejects(fixtures.mixed_lines(spark, sf_dir))


def audit_saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root use by way of gzip objects on disk and the saved table."""
    folder = run_folder(spark, "audit")
    objects = f"{folder}/objects"
    replay.write_objects(fixtures.audit_lines(spark, sf_dir), objects)
    events = audit.typed_records(audit.read_lines(spark, objects))
    name = "cloudtrailhive_" + folder.rsplit("-", 1)[-1]
    save_table(events, name, f"{folder}/table")
    return spark.sql(ROOT_USAGE_SQL.replace("cloudtrail", name))


# --- access logs to SQL ------------------------------------------------------


def access_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.parse_access_lines(fixtures.access_lines(spark, sf_dir))


def access_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.access_rejects(fixtures.access_lines(spark, sf_dir))


def access_distinct_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(access_parse(spark, sf_dir), ACCESS_TABLE)
    return spark.sql(ACCESS_IP_SQL)


def access_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the access log, the time as text of UTC."""
    rows = access.parse_full_lines(fixtures.full_access_lines(spark, sf_dir))
    return rows.withColumn("time", F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))


def access_full_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.full_rejects(fixtures.full_access_lines(spark, sf_dir))


def access_saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of log files and the saved table."""
    folder = run_folder(spark, "access")
    fixtures.access_lines(spark, sf_dir).write.text(f"{folder}/logs")
    name = "s3logshive_" + folder.rsplit("-", 1)[-1]
    create_access_saved_table(spark, f"{folder}/logs/part-", f"{folder}/table", name=name)
    return spark.sql(ACCESS_IP_SQL.replace("s3logs", name))


# --- addresses ---------------------------------------------------------------


def net_ip_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixtures.address_texts(spark, sf_dir).distinct()
    return texts.select("ip", ip_to_long("ip").alias("ip_long"))


def net_parse_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixtures.address_texts(spark, sf_dir).distinct()
    return texts.select("ip", parse_address("ip").alias("a")).select("ip", "a.hi", "a.lo")


def net_tor_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.exit_list(spark, sf_dir).select("ip")


def net_tor_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exit_node_rejects(fixtures.exit_lines(spark, sf_dir))


def net_tor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = audit.typed_events(fixtures.audit_event_texts(spark, sf_dir), "event_id")
    nodes = fixtures.exit_list(spark, sf_dir)
    rows = events.select("event_id", "sourceIPAddress")
    return from_exit_nodes(rows, "sourceIPAddress", nodes)


def net_tor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = audit.typed_events(fixtures.audit_event_texts(spark, sf_dir), "event_id")
    nodes = fixtures.exit_list(spark, sf_dir)
    addresses = events.select("sourceIPAddress").distinct()
    return with_exit_flag(addresses, "sourceIPAddress", nodes)


# --- notifications -----------------------------------------------------------


def notify_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = fixtures.notification_bodies(spark, sf_dir)
    return notifications.announced_objects(notifications.unwrap_notifications(bodies))


def notify_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = fixtures.notification_bodies(spark, sf_dir)
    return notifications.notification_rejects(notifications.unwrap_notifications(bodies))


# --- observations ------------------------------------------------------------


def json_deep_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.field_values(
        fixtures.deep_events(spark, sf_dir), [P.ACCESS_KEY_ID, P.PRINCIPAL_ARN], "event_id"
    )


ALL_PROFILERS = [*P.DEFAULT_PROFILERS, P.PRINCIPAL_PROFILER, P.SOURCE_IP_PROFILER]
NETWORK_PROFILER = P.Profiler(
    "SourceIP-Network",
    P.SOURCE_IP_ADDRESS,
    value="substring_index(value, '.', 2)",
    keep="value RLIKE '^[0-9.]+$'",
)


def observed(spark: SparkSession, sf_dir: str, chosen: list[P.Profiler]) -> DataFrame:
    return P.observations(fixtures.audit_event_texts(spark, sf_dir), P.profiled_fields(chosen))


def seen_once(spark: SparkSession, sf_dir: str, chosen: list[P.Profiler]) -> DataFrame:
    """What the chosen profilers saw, with only the lookups they need."""
    geo = any(p.uses("city", "country") for p in chosen)
    tor = any(p.uses("is_exit") for p in chosen)
    rows = P.wanted(observed(spark, sf_dir, chosen), chosen)
    return P.candidates(
        staged(rows, "observed") if geo else rows,
        chosen,
        fixtures.geo_blocks(spark, sf_dir) if geo else None,
        fixtures.exit_list(spark, sf_dir) if tor else None,
    )


def seen(spark: SparkSession, sf_dir: str, chosen: list[P.Profiler]) -> DataFrame:
    """The same as a table: profile steps read it repeatedly, the events only once."""
    return staged(seen_once(spark, sf_dir, chosen), "seen")


def obs_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir, ALL_PROFILERS)


def obs_profiler_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_once(spark, sf_dir, ALL_PROFILERS)


# --- profiles and alerts -----------------------------------------------------


def profile_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.first_seen(seen_once(spark, sf_dir, ALL_PROFILERS))


def profile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile as sorted lists of bounded length."""
    lists = listed(profiles.first_seen(seen(spark, sf_dir, ALL_PROFILERS)), "profiler")
    return lists.select("profiler", "n", "part", "parts", joined(F.col("values")).alias("listed"))


def profile_new_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.new_values(seen(spark, sf_dir, ALL_PROFILERS))


def profile_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.known_values(seen(spark, sf_dir, ALL_PROFILERS))


def profile_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profiler and batch: whether all it shows was known before."""
    counts = profiles.batch_counts(seen(spark, sf_dir, ALL_PROFILERS))
    return counts.select("profiler", "batch_id", "n_current", (F.col("n_new") == 0).alias("compliant"))


def alerts_of(profiler: P.Profiler) -> Query:
    """Alerts of one profiler: counts, and the new values as bounded lists."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = seen(spark, sf_dir, [profiler])
        lists = listed(profiles.new_values(found), "profiler", "batch_id").drop("n")
        counts = staged(profiles.batch_counts(found), "counts")
        return (
            profiles.deviations(found, counts)
            .join(lists, ["profiler", "batch_id"])
            .select(
                "batch_id",
                "profiler",
                deviation_subject(F.col("profiler")).alias("subject"),
                "n_new",
                "n_current",
                "n_profile",
                "n_intersection",
                "part",
                "parts",
                joined(F.col("values")).alias("new_values"),
            )
        )

    return query


def alerts_tor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sighting_messages(profiles.sightings(seen_once(spark, sf_dir, [P.TOR_PROFILER])))


def alert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every alert of every profiler shows, new and known."""
    found = seen(spark, sf_dir, ALL_PROFILERS)
    return profiles.alert_values(found, profiles.batch_counts(found).filter("alerts"))


def alert_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alert texts of every profiler, each with the profile its batch found."""
    found = seen(spark, sf_dir, ALL_PROFILERS)
    alerts = staged(profiles.deviations(found), "alerts")
    return deviation_messages(
        alerts, profiles.alert_values(found, alerts), profile=profiles.first_seen(found)
    )


def alerts_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that show in a batch more or less often than their history has it."""
    counts = frequencies(
        fixtures.audit_event_texts(spark, sf_dir),
        ALL_PROFILERS,
        fixtures.geo_blocks(spark, sf_dir),
        fixtures.exit_list(spark, sf_dir),
    )
    return frequency_alerts(staged(counts, "frequencies"))


#: Batches that a value may stay away in the queries on profiles that expire.
TTL = 20


def profile_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that left their profile because they stayed away, and when they came back."""
    return expiry.expired_values(seen(spark, sf_dir, ALL_PROFILERS), TTL)


def alerts_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch shows against profiles whose values expire."""
    return expiry.expiring_counts(seen(spark, sf_dir, ALL_PROFILERS), TTL)


def alerts_tor_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit nodes in use, once per actor."""
    return sighted_actors(fixtures.audit_event_texts(spark, sf_dir), fixtures.exit_list(spark, sf_dir))


def alerts_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a root account, with its batch."""
    return root_uses(fixtures.audit_event_texts(spark, sf_dir), "batch_id")


def sent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts and messages per profiler and batch, as a table: running totals read it twice."""
    return staged(profiles.increments(seen(spark, sf_dir, ALL_PROFILERS)), "sent")


def alert_counts_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.running_totals(
        sent_alerts(spark, sf_dir), "profiler", "batch_id", {"alerts": "alert_count"}
    ).select("profiler", "batch_id", "alert_count")


def profile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = fixtures.audit_event_texts(spark, sf_dir).select("batch_id")
    return profiles.profile_status(batches, sent_alerts(spark, sf_dir), ALL_PROFILERS)


# --- streams -----------------------------------------------------------------


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(spark, sf_dir).output("alerts").filter(
        F.col("kind") == P.DEVIATION
    ).drop("kind")


def stream_alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(spark, sf_dir).output("alert_messages").drop("kind")


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(spark, sf_dir).output("status").drop("profile_base")


def stream_notified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.notified_events(spark, sf_dir)


def stream_both_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.both_events(spark, sf_dir)


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.rejected_lines(spark, sf_dir)


def stream_object_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.faulty_objects(spark, sf_dir)


def stream_replay_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed_rejects(spark, sf_dir)


def stream_ingested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.ingested(spark, sf_dir)


def stream_exit_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.exit_reloads(spark, sf_dir)


def stream_tor_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.watched_arrivals(spark, sf_dir, root=False)


def stream_root_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.watched_arrivals(spark, sf_dir, root=True)


def stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.expired_arrivals(spark, sf_dir, TTL)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        audit_distinct_principals,
        audit_root_usage,
        audit_geo_lookup,
        audit_geo_sql_functions,
        audit_source_catalogue,
        audit_object_listing,
        audit_unnest_records,
        audit_unnest_all_fields,
        audit_place_function,
        audit_variant_fields,
        audit_inferred_columns,
        audit_line_rejects,
        audit_saved_table,
        access_parse,
        access_rejects,
        access_full,
        access_full_rejects,
        access_distinct_ip,
        access_saved_table,
        net_geo_networks,
        net_ip_to_long,
        net_parse_address,
        net_tor_nodes,
        net_tor_rejects,
        net_tor_events,
        net_tor_flags,
        notify_unwrap,
        notify_rejects,
        json_deep_values,
        obs_field_values,
        obs_profiler_expand,
        profile_first_seen,
        profile_state,
        profile_new_values,
        profile_known_values,
        profile_compliance,
    )
} | {
    "alerts_access_key": alerts_of(P.ACCESS_KEY_PROFILER),
    "alerts_arn": alerts_of(P.ARN_PROFILER),
    "alerts_principal": alerts_of(P.PRINCIPAL_PROFILER),
    "alerts_source_ip": alerts_of(P.SOURCE_IP_PROFILER),
    "alerts_city": alerts_of(P.GEO_CITY_PROFILER),
    "alerts_country": alerts_of(P.GEO_COUNTRY_PROFILER),
    "alerts_custom_network": alerts_of(NETWORK_PROFILER),
} | {
    f.__name__: f
    for f in (
        alerts_tor,
        alert_values,
        alert_bodies,
        alerts_frequency,
        alert_counts_running,
        profile_status,
        stream_alerts,
        stream_alert_messages,
        stream_status,
        stream_notified_events,
        stream_both_inputs,
        stream_rejects,
        stream_object_rejects,
        stream_replay_rejects,
        stream_ingested_counts,
        stream_exit_reload,
        profile_expired,
        alerts_expiring,
        alerts_tor_actor,
        alerts_root,
        stream_tor_actor,
        stream_root_alerts,
        stream_expired,
    )
}
