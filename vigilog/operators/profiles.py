"""Profiles and deviations, over any number of batches at once.

A profile only grows, so it has a closed form. With ``first_batch(v)`` the first
batch that shows value ``v`` and ``baseline`` the smallest of them:

* the profile before batch ``b`` is every ``v`` with ``first_batch(v) < b``;
* a batch after the baseline alerts when some ``first_batch(v) = b``, and those
  ``v`` are its new values.

The work is thus grouped by value and pre-aggregated before each shuffle; no
task ever holds a whole profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.operators.alerts import sections_of
from vigilog.operators.profilers import DEVIATION, SIGHTING, Profiler

#: Batches summed by one task in a running total.
BLOCK = 4096


def first_seen(seen: DataFrame) -> DataFrame:
    """``(profiler, value, first_batch)`` of the deviation profilers."""
    return (
        seen.filter(F.col("kind") == DEVIATION)
        .groupBy("profiler", "value")
        .agg(F.min("batch_id").alias("first_batch"))
    )


def baselines(seen: DataFrame) -> DataFrame:
    """``(profiler, baseline)``: the batch a profile started with, which never alerts.

    One row per configured profiler, a handful, hence safe to broadcast.
    """
    return F.broadcast(
        seen.filter(F.col("kind") == DEVIATION)
        .groupBy("profiler")
        .agg(F.min("batch_id").alias("baseline"))
    )


def profile_before(profile: DataFrame, batch_id: int | Column) -> DataFrame:
    """The values of each profile as batch ``batch_id`` finds it."""
    return profile.filter(F.col("first_batch") < batch_id)


def judged(seen: DataFrame) -> DataFrame:
    """``seen`` with ``is_new``, for the deviation profilers.

    A value may be null, hence the null-safe key.
    """
    known = first_seen(seen).withColumnsRenamed({"profiler": "_p", "value": "_v"})
    return (
        seen.filter(F.col("kind") == DEVIATION)
        .join(known, (F.col("profiler") == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v")))
        .select(
            "profiler",
            "batch_id",
            "value",
            (F.col("first_batch") == F.col("batch_id")).alias("is_new"),
        )
    )


def new_values(seen: DataFrame) -> DataFrame:
    """``(profiler, batch_id, value)``: what deviated, without what complied."""
    return (
        first_seen(seen)
        .join(baselines(seen), "profiler")
        .filter("first_batch > baseline")
        .select("profiler", F.col("first_batch").alias("batch_id"), "value")
    )


def known_values(seen: DataFrame) -> DataFrame:
    """``(profiler, batch_id, value)``: what a batch shows that its profile holds."""
    return judged(seen).filter(~F.col("is_new")).select("profiler", "batch_id", "value")


def batch_counts(seen: DataFrame) -> DataFrame:
    """Per profiler and batch: current, new and known values; whether it alerts.

    What a batch shows and what is first seen in it are counted apart and joined
    as counts, so no observation meets the first batch of its value.
    """
    shown = (
        seen.filter(F.col("kind") == DEVIATION)
        .groupBy("profiler", "batch_id")
        .agg(F.count("*").alias("n_current"))
    )
    fresh = (
        first_seen(seen)
        .groupBy("profiler", F.col("first_batch").alias("batch_id"))
        .agg(F.count("*").alias("n_new"))
    )
    n_new = F.coalesce("n_new", F.lit(0))
    return (
        shown.join(fresh, ["profiler", "batch_id"], "left")
        .join(baselines(seen), "profiler")
        .select(
            "profiler",
            "batch_id",
            "n_current",
            n_new.alias("n_new"),
            (F.col("n_current") - n_new).alias("n_intersection"),
            ((F.col("batch_id") > F.col("baseline")) & (n_new > 0)).alias("alerts"),
        )
    )


def deviations(seen: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per alert: its counts, ``n_profile`` being the profile's size before it.

    ``counts`` are the :func:`batch_counts`, for a caller who has them as a table:
    the running total reads them twice.
    """
    counts = batch_counts(seen) if counts is None else counts
    grown = running_totals(counts, "profiler", "batch_id", {"n_new": "grown"})
    return grown.filter("alerts").select(
        "profiler",
        "batch_id",
        "n_new",
        "n_current",
        (F.col("grown") - F.col("n_new")).alias("n_profile"),
        "n_intersection",
    )


def alert_values(seen: DataFrame, alerts: DataFrame) -> DataFrame:
    """``(profiler, batch_id, section, value)``: what each alert shows, in full.

    ``alerts`` needs ``profiler`` and ``batch_id``. A long table, so an alert of any
    size is whole and no task holds its list. The profile of an alert is not copied
    into it: it is :func:`profile_before` of the first-seen table.
    """
    alerting = alerts.select("profiler", "batch_id")
    return sections_of(judged(seen).join(alerting, ["profiler", "batch_id"], "left_semi"))


def profile_lists(profile: DataFrame, alerts: DataFrame) -> DataFrame:
    """What each alert's profile held, as section rows.

    That is every earlier value once per alert, the size the alert texts have.
    Over a long history only small profiles are worth it; a stream lists the
    profile of one batch at a time.
    """
    before = alerts.select("profiler", "batch_id").join(profile, "profiler")
    return profile_before(before, F.col("batch_id")).select(
        "profiler", "batch_id", F.lit("profile").alias("section"), "value"
    )


def sightings(seen: DataFrame) -> DataFrame:
    """``(profiler, batch_id, value)`` of the profilers that report every value."""
    return seen.filter(F.col("kind") == SIGHTING).select("profiler", "batch_id", "value")


def increments(seen: DataFrame) -> DataFrame:
    """``(profiler, batch_id, alerts, messages)`` of the batches that sent any.

    A batch counts as one alert, though sightings send a message per value. A
    message that goes out in several parts counts once.
    """
    sent = (
        new_values(seen)
        .select("profiler", "batch_id")
        .distinct()
        .withColumn("messages", F.lit(1).cast("bigint"))
    )
    seen_again = sightings(seen).groupBy("profiler", "batch_id").agg(
        F.count("*").alias("messages")
    )
    return sent.unionByName(seen_again).withColumn("alerts", F.lit(1))


def running_totals(rows: DataFrame, key: str, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds running sums along ``order``, which must be unique within ``key``.

    Summed in two levels, so that a long history does not end up in one task:
    within blocks of the order, then over the block totals.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    totals = blocked.groupBy(key, "_block").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sums]
    )
    before = (
        Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        key,
        "_block",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums],
    )
    within = (
        Window.partitionBy(key, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums])
        .join(carried, [key, "_block"])
        .select(
            *rows.columns,
            *[(F.col(f"_w_{c}") + F.col(f"_t_{c}")).alias(out) for c, out in sums.items()],
        )
    )


def status_line(profiler: Column, field: Column, count: Column) -> Column:
    # Fixed value: the wording of a status line.
    return F.concat(
        F.lit("The "), profiler, F.lit(" profiler for the field "), field,
        F.lit(" has issued "), count, F.lit(" alerts."),
    )


def profile_status(
    batches: DataFrame, sent: DataFrame, profilers: list[Profiler]
) -> DataFrame:
    """State of every profiler after every batch in ``batches(batch_id)``.

    ``sent`` are the :func:`increments`; it and ``batches`` are read twice, so hand
    over tables where they are costly. ``alert_count`` counts batches that alerted,
    ``messages`` what was sent, ``update_count`` the batches so far, with or without
    activity.
    """
    named = [
        F.struct(F.lit(p.name).alias("profiler"), F.lit(p.field).alias("field")) for p in profilers
    ]
    grid = (
        batches.select("batch_id")
        .distinct()
        .select("batch_id", F.explode(F.array(*named)).alias("p"), F.lit(1).alias("one"))
        .select("batch_id", "p.profiler", "p.field", "one")
    )
    filled = grid.join(sent, ["profiler", "batch_id"], "left").fillna(
        0, ["alerts", "messages"]
    ).withColumnRenamed("messages", "sent")
    totals = running_totals(
        filled, "profiler", "batch_id",
        {"alerts": "alert_count", "sent": "messages", "one": "update_count"},
    )
    return totals.select(
        "batch_id",
        "profiler",
        "field",
        "alert_count",
        "messages",
        "update_count",
        status_line(F.col("profiler"), F.col("field"), F.col("alert_count")).alias("line"),
    )
