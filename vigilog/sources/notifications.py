"""Notifications of new objects: JSON whose ``Message`` is again JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.deep_json import all_values

# The field names of a notification.
MESSAGE_FIELD = "Message"
BUCKET_FIELD = "s3Bucket"
KEYS_FIELD = "s3ObjectKey"


def unwrap_notifications(bodies: DataFrame) -> DataFrame:
    """``(line, bucket, key, reason)`` of notification bodies in ``value``.

    One row per object key, or one with a ``reason`` for whatever cannot be
    used. ``Message`` and the bucket count at any depth, the key list only at
    the top. Keys repeated within a message come once.
    """
    messages = (
        bodies.select(
            F.col("value").alias("line"), all_values(F.col("value"), [MESSAGE_FIELD]).alias("m")
        )
        .select("line", "m", F.explode_outer("m").alias("p"))
        .select(
            "line",
            F.when(F.col("m").isNull(), "not JSON")
            .when(F.size("m") == 0, f"no {MESSAGE_FIELD}")
            .alias("body_reason"),
            F.col("p.value").alias("message"),
        )
    )
    opened = messages.select(
        "line",
        "body_reason",
        all_values(F.col("message"), [BUCKET_FIELD]).alias("buckets"),
        F.try_parse_json("message").alias("tree"),
    ).select(
        "line",
        "body_reason",
        "buckets",
        F.try_variant_get("tree", f"$.{KEYS_FIELD}", "variant").alias("listed"),
        F.array_distinct(
            F.transform(
                F.try_variant_get("tree", f"$.{KEYS_FIELD}", "array<variant>"),
                lambda k: F.struct(
                    (F.schema_of_variant(k) == "STRING").alias("is_text"),
                    F.try_variant_get(k, "$", "string").alias("text"),
                ),
            )
        ).alias("keys"),
    )
    rows = opened.select("*", F.explode_outer("keys").alias("k"))
    bucket = F.get("buckets", F.lit(0))["value"]
    reason = (
        F.when(F.col("body_reason").isNotNull(), F.col("body_reason"))
        .when(F.col("buckets").isNull(), f"{MESSAGE_FIELD} is not JSON")
        .when(
            F.size("buckets") != 1,
            F.concat(F.lit(f"expected one {BUCKET_FIELD}, found "), F.size("buckets")),
        )
        .when(F.col("listed").isNull(), f"no {KEYS_FIELD}")
        .when(F.coalesce(F.size("keys"), F.lit(0)) < 1, f"empty {KEYS_FIELD}")
        .when(~F.col("k.is_text"), "key is not text")
        .when(bucket == "", "empty bucket")
        .when(F.col("k.text") == "", "empty key")
    )
    return rows.select(
        "line", bucket.alias("bucket"), F.col("k.text").alias("key"), reason.alias("reason")
    )


def announced_objects(unwrapped: DataFrame) -> DataFrame:
    return unwrapped.filter("reason is null").select("bucket", "key")


def notification_rejects(unwrapped: DataFrame, source: str = "notification") -> DataFrame:
    return unwrapped.filter("reason is not null").select(
        F.lit(source).alias("source"), "line", "reason"
    )


def object_path(template: str) -> Column:
    """Path of an announced object, e.g. of ``s3a://{bucket}/{key}``."""
    return F.replace(
        F.replace(F.lit(template), F.lit("{bucket}"), F.col("bucket")),
        F.lit("{key}"),
        F.col("key"),
    )
