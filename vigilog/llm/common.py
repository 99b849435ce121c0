"""Helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.session import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter. All-ASCII texts take the fast built-in."""
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(mapped)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other name can clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"))


# --- vectorised polynomial hashes over bytes, modulo 2**64 ---------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base ("up") or of its inverse ("down")."""
    have = _powers[kind]
    if len(have) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        size = 1 << (n - 1).bit_length()
        factors = np.full(size, step, np.uint64)
        factors[0] = 1
        have = _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


class RangeHash:
    """Hashes of any byte ranges of a buffer after one pass over it.

    Equal ranges have equal hashes; callers confirm equality on the bytes.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=self.sums[1:])
        self.down = _power("down", n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``most`` at a time."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


# --- groups of any size --------------------------------------------------------------------


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``at``, the place from 0 of each row in its group, for groups of any size.

    Rows are sorted by range, so that a large group lies in several partitions, and numbered within each of
    them. Only the first group of a partition can go on from the one before, so the offsets are fewer than the
    partitions, which bounds their broadcast.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tie.repartitionByRange(*group, *order, "_tie").drop("_tie")
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_n").over(before)).filter("_before is not null")
    within = Window.partitionBy("_part", *group).orderBy(*order)
    counted = dealt.withColumn("_at", F.row_number().over(within))
    return counted.join(F.broadcast(offsets.drop("_n")), ["_part", *group], "left").select(
        *rows.columns, (F.col("_at") - 1 + F.coalesce("_before", F.lit(0))).cast("long").alias("at")
    )


#: Parts that a hot key is dealt to.
SALTS = 256


def spread_join(rows: DataFrame, key: str, values: DataFrame, by: str) -> DataFrame:
    """Joins ``values``, unique by ``key``, to rows of which very many may have the same key.

    The key meets its value once per part; the rows, dealt to parts by the column ``by``, meet their part.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = dealt.select(key, "_salt").distinct().join(values, key)
    return dealt.join(parts, [key, "_salt"]).drop("_salt")
