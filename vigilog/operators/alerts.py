"""Alerts as rows: bounded lists of values, subjects and bodies."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.text import joined, printed

#: Values one row lists on average, unless the caller says otherwise. Longer lists
#: go on in further rows, numbered and complete.
VALUES_PER_PART = 10_000

#: Batches whose alerts share one copy of the profile's lists, and the keys that the making of the lists is spread over.
BLOCK, SPREAD = 4096, 64

#: Values of a profile packed at a time, and bytes of packs or texts handed on at a time.
CHUNK, HANDED_ON = 1 << 17, 4 << 20

#: New values that are put into a sorted list one by one; more are sorted with it.
FEW = 64

# The wording of the alerts.
EOL = "\r\n"
DEVIATION_SUBJECT = "CloudTrail Profile Mismatch for "
NEW_LABEL = "New activity which doesn't fit current profile: "
CURRENT_LABEL = "Current activity (including compliant activity): "
PROFILE_LABEL = "Current profile (which was not matched): "
INTERSECTION_LABEL = (
    "The following is the intersection between the existing profile and new activity: "
)
CLOSING = "The profile will be updated (to avoid duplicate alarms)"
SIGHTING_SUBJECT = "Anonymizing proxy in use with your AWS account"
SIGHTING_BODY = ("Activity on your AWS resources has been seen from ", " which is a Tor exit node.")

NEW, CURRENT, PROFILE, INTERSECTION = "new", "current", "profile", "intersection"


def parts_for(largest: Column, per_part: int) -> Column:
    """Rows to spread lists over, given the size of the largest."""
    return F.greatest(F.lit(1), F.ceil(largest / per_part)).cast("bigint")


def part_of(value: Column, parts: Column) -> Column:
    """The row, from 1, that lists a value."""
    return F.pmod(F.xxhash64(value), parts) + 1


def listed(rows: DataFrame, *keys: str, per_part: int = VALUES_PER_PART) -> DataFrame:
    """The values of each group as sorted lists, ``part`` of ``parts``.

    A group of any size is written in full, over as many rows as it needs, so
    no task collects an unbounded one.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("parts", parts_for(F.col("n"), per_part))
    return (
        rows.join(sizes, list(keys))
        .groupBy(*keys, "n", "parts", part_of(printed(F.col("value")), F.col("parts")).alias("part"))
        .agg(F.array_sort(F.collect_list(printed(F.col("value")))).alias("values"))
        .select(*keys, "n", "part", "parts", "values")
    )


def deviation_subject(profiler: Column) -> Column:
    return F.concat(F.lit(DEVIATION_SUBJECT), profiler)


def versioned_lists(split: DataFrame, profile: DataFrame) -> DataFrame:
    """``(profiler, parts, block, part, held)``: the profile as sorted lists that the alerts of a block share.

    An entry of ``held`` has the ``text`` of a value and its ``first_batch``, so that an alert takes what is older
    than itself. ``split(profiler, batch_id, parts, block)`` are the alerts. A profiler's values are listed once for each number of
    parts and block in use, not once per alert; a list has as many values as a part may have.
    """
    levels = split.groupBy("profiler", "parts", "block").agg(F.max("batch_id").alias("upto"))
    levels = levels.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    text = printed(F.col("value"))
    values = profile.select(
        "profiler", "first_batch", text.alias("text"), F.pmod(F.xxhash64(text), F.lit(SPREAD)).cast("int").alias("salt")
    )
    return (
        values.join(levels, ["profiler", "salt"])
        .filter("first_batch < upto")
        .groupBy("profiler", "parts", "block", part_of(F.col("text"), F.col("parts")).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("text", "first_batch"))).alias("held"))
    )


def _packs(texts: pa.Array, first: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, data) of values sorted by part: lengths, first batches and texts, by columns and compressed."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    letters = texts.buffers()[2] or pa.py_buffer(b"")
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        sizes = np.diff(ends[i : j + 1]).astype(np.int32)
        planes = [c.view(np.uint8).reshape(j - i, -1).T.tobytes() for c in (sizes, np.ascontiguousarray(first[i:j]))]
        raw = b"".join([*planes, letters[int(ends[i]) : int(ends[j])].to_pybytes()])
        yield int(part[i]), (j - i).to_bytes(4) + len(raw).to_bytes(8) + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The texts of a pack and their first batches."""
    n, size = int.from_bytes(data[:4]), int.from_bytes(data[4:12])
    raw = pa.decompress(data[12:], size, "zstd", asbytes=True)

    def column(start: int, kind: type) -> np.ndarray:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, start).reshape(width, n)
        return np.ascontiguousarray(planes.T).reshape(-1).view(kind)

    ends = (12 * n + np.r_[0, np.cumsum(column(0, np.int32), dtype=np.int64)]).tolist()
    return [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], column(4 * n, np.int64)


_PACK = "profiler string, parts long, block long, part long, data binary"


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of (profiler, values(text, first_batch, mark), levels(parts, block, upto)), for each level and part."""
    rows: list[tuple] = []
    held = 0

    def handed_on() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PACK.split(", ")])

    for batch in batches:
        for k, profiler in enumerate(batch.column(0).to_pylist()):
            text, first, mark = batch.column(1)[k].values.flatten()
            first, mark = first.to_numpy(), mark.to_numpy()
            for level in batch.column(2)[k].as_py():
                older = np.flatnonzero(first < level["upto"])
                part = mark[older] % level["parts"] + 1
                order = np.argsort(part, kind="stable")
                older, part = older[order], part[order]
                if not len(older):
                    continue
                for number, data in _packs(text.take(pa.array(older)).cast(pa.string()), first[older], part):
                    rows.append((profiler, level["parts"], level["block"], number, data))
                    held += len(data)
                    if held > HANDED_ON:
                        yield handed_on()
                        rows, held = [], 0
    if rows:
        yield handed_on()


def packed_lists(split: DataFrame, profile: DataFrame) -> DataFrame:
    """:func:`versioned_lists` as packs of bytes, several for a list; a value takes a few bytes in each list it is in.

    ``split`` has ``n_profile`` too. Values are packed in chunks of about ``CHUNK``, sorted by text.
    """
    levels = split.groupBy("profiler", "parts", "block").agg(
        F.max("batch_id").alias("upto"), F.max("n_profile").alias("n")
    )
    # One row per profiler, hence safe to broadcast.
    levels = F.broadcast(levels.groupBy("profiler").agg(
        F.collect_list(F.struct("parts", "block", "upto")).alias("levels"),
        F.max("upto").alias("upto"),
        F.ceil((F.max("n") + 1) / CHUNK).alias("chunks"),
    ))
    text = printed(F.col("value"))
    values = profile.select("profiler", F.col("first_batch").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))
    values = values.join(levels.select("profiler", "upto", "chunks"), "profiler").filter("first_batch < upto")
    chunks = values.groupBy("profiler", F.expr("pmod(mark, chunks)").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("text", "first_batch", "mark"))).alias("values")
    )
    return chunks.join(levels, "profiler").select("profiler", "values", "levels").mapInArrow(_dealt, _PACK)


_BODY = "profiler string, batch_id long, part long, parts long, body string"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bodies of alerts, from rows sorted by list and batch: the packs of a list, then the alerts that show it.

    The values of a list join it in the order of their first batch, so each alert lists what is older than itself.
    """
    rows: list[tuple] = []
    size, key = 0, None
    packs: list[tuple] = []
    coming, first, held, at = [], np.zeros(0, np.int64), [], 0

    def handed_on() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BODY.split(", ")])

    for batch in batches:
        for profiler, parts, block, part, batch_id, data, before, after in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if (profiler, parts, block, part) != key:
                key, packs, coming, first, held, at = (profiler, parts, block, part), [], [], first[:0], [], 0
            if data is not None:
                packs.append(_unpacked(data))
                continue
            if packs:
                texts = [t for pack in packs for t in pack[0]]
                first = np.concatenate([pack[1] for pack in packs])
                order = np.argsort(first, kind="stable")
                coming, first, packs = [texts[k] for k in order.tolist()], first[order], []
            older = int(np.searchsorted(first, batch_id))
            if older - at > FEW:
                held += coming[at:older]
                held.sort()
            else:
                for t in coming[at:older]:
                    insort(held, t)
            at = older
            body = b"".join([before, b",".join(held), after])
            rows.append((profiler, batch_id, part, parts, body))
            size += len(body)
            if size > HANDED_ON:
                yield handed_on()
                rows, size = [], 0
    if rows:
        yield handed_on()


def deviation_messages(
    alerts: DataFrame,
    sections: DataFrame,
    per_part: int = VALUES_PER_PART,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Subject and body of each alert.

    ``alerts`` has a row with the counts of :func:`profiles.deviations` per
    alert, ``sections(profiler, batch_id, section, value)`` what it lists. The
    lists are sorted. An alert with more than ``per_part`` values in a list goes out
    in ``parts`` texts of the same form, each listing its share of every set.
    ``profile(profiler, value, first_batch)`` are the profiles over all batches: each alert lists what
    its batch found there. Without it, the profile is one of the sections.
    """
    parts = parts_for(F.greatest("n_current", "n_profile"), per_part).alias("parts")
    split = alerts.select("profiler", "batch_id", parts)
    text = printed(F.col("value"))
    shares = sections.join(split, ["profiler", "batch_id"]).select(
        *split.columns, part_of(text, F.col("parts")).alias("part"), "section", text.alias("text")
    )
    # One empty share per part, so that every announced part exists.
    nothing = F.lit(None).cast("string")
    every_part = split.select(
        "*",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("parts"))).alias("part"),
        nothing.alias("section"),
        nothing.alias("text"),
    )

    def share(section: str) -> Column:
        chosen = F.when(F.col("section") == section, F.col("text"))
        return F.array_sort(F.collect_list(chosen)).alias(section)

    lists = (
        shares.unionByName(every_part)
        .groupBy(*split.columns, "part")
        .agg(*[share(s) for s in (NEW, CURRENT, PROFILE, INTERSECTION)])
    )
    before = F.concat(
        F.lit(NEW_LABEL), joined(F.col(NEW)), F.lit(EOL),
        F.lit(EOL + CURRENT_LABEL), joined(F.col(CURRENT)), F.lit(EOL),
        F.lit(PROFILE_LABEL),
    )
    after = F.concat(
        F.lit(EOL), F.lit(INTERSECTION_LABEL), joined(F.col(INTERSECTION)), F.lit(EOL),
        F.lit(EOL + CLOSING),
    )
    if profile is None:
        bodies = lists.withColumn("body", F.concat(before, joined(F.col(PROFILE)), after))
    else:
        block = F.floor(F.col("batch_id") / BLOCK).alias("block")
        packs = packed_lists(alerts.select("profiler", "batch_id", parts, "n_profile", block), profile)
        key = ["profiler", "parts", "block", "part"]
        nothing = F.lit(None)
        shown = lists.select(
            *key[:2], block, "part", F.col("batch_id").cast("long"), nothing.cast("binary").alias("data"),
            before.cast("binary").alias("before"), after.cast("binary").alias("after"),
        )
        packs = packs.select(
            *key, nothing.cast("long").alias("batch_id"), "data",
            nothing.cast("binary").alias("before"), nothing.cast("binary").alias("after"),
        )
        # A number, as few bytes come in for the long texts that go out.
        tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = shown.unionByName(packs).repartition(tasks, *key).sortWithinPartitions(*key, "batch_id")
        bodies = dealt.mapInArrow(_written, _BODY)
    return bodies.select(
        "profiler",
        "batch_id",
        "part",
        "parts",
        deviation_subject(F.col("profiler")).alias("subject"),
        "body",
    )


def sections_of(judged: DataFrame) -> DataFrame:
    """The new, current and intersection sections of judged batches, in one pass."""
    kinds = F.array_compact(
        F.array(
            F.lit(CURRENT),
            F.when(F.col("is_new"), NEW).otherwise(INTERSECTION),
        )
    )
    return judged.select("profiler", "batch_id", F.explode(kinds).alias("section"), "value")


def sighting_messages(sightings: DataFrame) -> DataFrame:
    """One message per address and batch."""
    before, after = SIGHTING_BODY
    return sightings.select(
        "profiler",
        "batch_id",
        F.col("value").alias("address"),
        F.lit(SIGHTING_SUBJECT).alias("subject"),
        F.concat(F.lit(before), F.col("value"), F.lit(after)).alias("body"),
    )
