"""Exact duplicates through an extendible-hash index on shared files.

Texts are hashed to 64-bit keys. The directory maps the leading bits of a key to a bucket; a bucket
that holds more keys than its capacity is split on one more bit, which doubles the directory there, until
all fit. Texts reach their bucket through the directory. The owner task of a bucket, which is a range of keys,
compares the bytes of the texts under each key, chains those that collide, and decides which document stays. A
document finds its entry the same way: cell, bucket, key, then the link of the chain with its digest.

How it scales: before texts are dealt to owners, those of equal bytes are merged on the map side and in
``PARTS`` parts by id, so a text that a third of all rows repeat reaches its owner as ``PARTS`` rows at most. All
other steps move fixed-size rows. The directory is a table with at most ``2 ** max_depth`` rows, which bounds its
broadcast; only its row counts reach the driver.

Defined cases: a null text counts as empty; an empty table gives an empty result; among equal texts the
largest id stays, nulls being smallest; rows that repeat both id and text are one document and share
its fate, each counted in ``group_size``; an id with several texts is judged for each text alone. Other columns
of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import ascii_lower, id_and_text
from vigilog.session import staged

#: Entries a bucket may hold before it is split.
CAPACITY = 4096
#: Most key bits the directory may use. Buckets at this depth chain whatever they hold.
MAX_DEPTH = 20
#: Parts by id in which equal texts are merged before they reach the owner of their bucket.
PARTS = 16


@dataclass(frozen=True)
class HashIndex:
    directory: DataFrame  #: cell (the leading max_depth bits), bucket, depth
    entries: DataFrame  #: bucket, key, chain, sha, keep_id, group_size
    rows: DataFrame  #: bucket, key, sha, doc_id of every document


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def build_directory(cells: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """Splits overfull buckets until all fit. ``cells``: entries ``n`` by leading bits ``cell``."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1.0, total / capacity)))))
    done, still = None, cells
    while True:
        prefix = F.shiftrightunsigned("cell", max_depth - depth)
        load = F.sum("n").over(Window.partitionBy(prefix))
        sized = staged(
            still.select("cell", "n", prefix.alias("prefix"), load.alias("load")), "directory"
        )
        fits = (F.col("load") <= capacity) | F.lit(depth == max_depth)
        fit = sized.filter(fits).select(
            "cell",
            (F.col("prefix") + F.lit(1 << depth)).cast("long").alias("bucket"),
            F.lit(depth).alias("depth"),
        )
        done = fit if done is None else done.unionByName(fit)
        still = sized.filter(~fits).select("cell", "n")
        if still.isEmpty():
            return done
        depth += 1


def _key(norm: Column, key_bits: int) -> Column:
    return F.shiftleft(F.xxhash64(norm), 64 - key_bits)


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
    key_bits: int = 64,
) -> HashIndex:
    """The index of all texts. Fewer ``key_bits`` only make more keys collide."""
    norm = ascii_lower(F.col("text"))
    texts = id_and_text(docs, id_col, text_col).select("doc_id", norm.alias("norm"))
    texts = texts.withColumn("key", _key(F.col("norm"), key_bits))
    keyed = staged(texts.select("doc_id", "key", _digest(F.col("norm")).alias("sha")), "keys")
    cell = _leading(F.col("key"), max_depth).alias("cell")
    cells = keyed.select("key").distinct().groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    directory = build_directory(cells, capacity, max_depth)
    # At most 2 ** max_depth rows, whatever the number of documents.
    routes = F.broadcast(directory.select("cell", "bucket"))

    def routed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cell", cell).join(routes, "cell").drop("cell")

    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    merged = routed(texts).groupBy("bucket", "key", "norm", part).agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")
    )
    # Whole buckets go to one owner, which groups by the bytes of the text, not by a digest.
    owned = merged.drop("part").repartition("bucket").groupBy("bucket", "key", "norm").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size")
    )
    links = owned.select("bucket", "key", _digest(F.col("norm")).alias("sha"), "keep_id", "group_size")
    chain = F.row_number().over(
        Window.partitionBy("bucket", "key").orderBy(F.desc_nulls_last("keep_id"), "sha")
    )
    entries = links.withColumn("chain", chain).sortWithinPartitions("bucket", "key")
    return HashIndex(directory, staged(entries, "index"), routed(keyed))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
    key_bits: int = 64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, capacity, max_depth, key_bits)
    found = index.rows.join(index.entries, ["bucket", "key", "sha"])
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = build_index(docs, id_col, text_col)
    keep = index.entries.select(F.col("keep_id").alias("__keep_id"), F.col("sha").alias("__sha"))
    norm = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    stays = docs[id_col].cast("long").eqNullSafe(keep["__keep_id"]) & (_digest(norm) == keep["__sha"])
    return docs.join(keep, stays, "left_semi")
