"""Near duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits. It is cut into three segments; of two fingerprints that differ in at most
``RADIUS`` = 4 bits, one segment differs in at most one. So every fingerprint is put into a table under each
of its segments, and looked up under each of its segments and under every segment that one flipped bit
makes. A pair one bit apart is found from the side whose bit is set, so only set bits are flipped, which
halves the lookups. Every match is verified on all 64 bits. Nothing is missed.

How it scales: equal fingerprints are one row before any join. A dense group of near copies would still
match itself in all pairs; so first each fingerprint is compared only with the least one that shares a
segment, those links are contracted to components, and the full lookup returns only pairs whose two sides
are not yet in one component. Hot fingerprints stay with their documents and join by an equality that
adaptive execution splits.

Defined cases: a null or empty text has fingerprint 0 and links like any other; an empty table gives an
empty result; repeated rows are each returned; a null id is never a component's id unless all are null.
Texts are hashed in pieces, whatever their length. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.components import components
from vigilog.llm.common import id_and_bytes
from vigilog.session import staged

WORDS = 4
SEED = 42
RADIUS = 4
#: (first bit, bits) of the segments. Three segments and a ball of one bit cover a radius of up to 5.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bytes of one text that are cut into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        stop = start + PIECE
        if stop < len(data):
            gap = _SPACE.search(data, stop)
            stop = gap.start() if gap else len(data)
        yield data[start:stop]
        start = stop


def fingerprint(data: bytes) -> int:
    """The SimHash of the word shingles of a text, as a signed 64-bit number."""
    votes, total = np.zeros(64, np.int64), 0
    carried: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(data):
        words = carried + piece.lower().split()
        carried = words[-(WORDS - 1) :]
        if len(words) < WORDS:
            carried = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - WORDS + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)]
        total += len(hashes)
        votes += _votes(hashes)
    if not total and carried:
        total, votes = 1, _votes([digest(b" ".join(carried), SEED)])
    bits = np.packbits(votes * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _votes(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    return id_and_bytes(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment(fp, first: int, bits: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND((1 << bits) - 1)


def _slots(points: DataFrame) -> DataFrame:
    """Each fingerprint under each of its segments: (slot, fp, part)."""
    slots = [
        F.lit(k << 24).cast("long") + _segment(F.col("fp"), *segment)
        for k, segment in enumerate(SEGMENTS)
    ]
    return points.select("fp", "part", F.explode(F.array(*slots)).alias("slot"))


def _lookups(points: DataFrame) -> DataFrame:
    """Each fingerprint under the slots of its half balls: (slot, fp, part, same)."""
    wanted = []
    for k, (first, bits) in enumerate(SEGMENTS):
        slot = F.lit(k << 24).cast("long") + _segment(F.col("fp"), first, bits)
        wanted.append(F.struct(slot.alias("slot"), F.lit(True).alias("same")))
        for j in range(bits):
            is_set = F.col("fp").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), first + j)) != 0
            flipped = F.struct((slot - (1 << j)).alias("slot"), F.lit(False).alias("same"))
            wanted.append(F.when(is_set, flipped))
    balls = points.select("fp", "part", F.explode(F.array_compact(F.array(*wanted))).alias("w"))
    return balls.select("fp", "part", "w.slot", "w.same")


def _apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) fingerprints whose components are those of all pairs within ``RADIUS`` bits."""
    points = staged(fps.select("fp").distinct().withColumn("part", F.col("fp")), "fingerprints")
    slots = _slots(points)
    least = slots.groupBy("slot").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = least.filter("n > 1").select("slot", "head")
    first = slots.join(heads, "slot").filter("fp <> head")
    first = first.filter(_apart(F.col("fp"), F.col("head")) <= RADIUS)
    near = staged(first.select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct(), "links")
    parts = components(near)
    known = points.select("fp").join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    known = staged(known.select("fp", F.coalesce("component", "fp").alias("part")), "parts")
    left, right = _lookups(known).alias("l"), _slots(known).alias("r")
    meet = (
        (F.col("l.slot") == F.col("r.slot"))
        & (F.col("l.part") != F.col("r.part"))
        & (~F.col("l.same") | (F.col("l.fp") < F.col("r.fp")))
        & (_apart(F.col("l.fp"), F.col("r.fp")) <= RADIUS)
    )
    rest = left.join(right, meet).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    return near.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id)."""
    rows = staged(fingerprints(docs, id_col, text_col), "rows")
    heads = rows.groupBy("fp").agg(F.min("doc_id").alias("head"))
    parts = components(links(rows))
    grouped = heads.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = staged(grouped.select("fp", "head", F.coalesce("component", "fp").alias("part")), "groups")
    least = grouped.groupBy("part").agg(F.min("head").alias("component_id"))
    # A table, so that the join below is one of two shuffles and a hot fingerprint can be split.
    of_fp = staged(grouped.join(least, "part").select("fp", "component_id"), "answers")
    return rows.join(of_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id of each component, with all its columns."""
    found = near_duplicates(docs, id_col, text_col)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.col("doc_id").alias("__keep_id"))
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["__keep_id"]), "left_semi")
