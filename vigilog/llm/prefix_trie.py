"""A trie of conversation prefixes, built by van Emde Boas recursion.

A trie of height 2^(k+1) is cut at half its depth. The cut prefixes get names, and the sequences that share one
collapse into one row with a weight; these make the upper trie, and what follows below each name makes the
lower forests. Upper trie and forests have the same height, so all of them, of all blocks, are one table and go
through the next round together: a logarithmic number of rounds for any depth. A name is the SHA-256
of the name above the block and of the turns in between, whose digests come from a table of blocks of 1, 2, 4, ...
turns. So naming needs no join on a shared prefix, and a prefix that a third of all conversations share is
only a key of a sum, which combines before the shuffle.

Totals are grafted upward in two sweeps over the same blocks. First each block's own total is added to the node
above it, small blocks first. Then each node adds the whole totals of the nodes at the lower edge of its block,
large blocks first. Every node moves once per sweep.

How it scales: turns are numbered by a range sort and offsets, so one conversation may hold any share of the rows;
texts are hashed where they are read and never shuffled; parents hand their id to children in parts; the ids of equal
conversations are joined in chunks and hashed as a stream. Each round is a table in the shared folder.

Defined cases: rows with a null id take no part; a null role or text is empty; null turns come first, equal turns go by
role, then by SHA-256 of the text, and equal rows all count; no conversations, no rows, not even a root; an
empty text counts no code points. Two turns are equal when SHA-256 of role and text is. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import numbered, spread_join
from vigilog.session import staged

ROOT = b"root"
#: Turns taken from the first conversation of a hundred, at most.
BORROWED = 5
HUNDRED = 100
#: Turns that look up their conversation's shift under one key.
RUN = 4096
#: Ids joined into one text before they are hashed.
CHUNK = 4096


def _hashed(*parts: Column | str) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


# --- sequences -----------------------------------------------------------------------------


def turns_of(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(c, at, turn, chars): each conversation's turns by number, with digest and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    read = rows.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), role.alias("role"),
        F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("chars"),
    ).filter("c is not null")
    at = numbered(read, ["c"], ["t", "role", "sha"])
    name = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("sha"))
    return at.select("c", "at", _hashed(name.cast("binary")).alias("turn"), "chars")


def with_borrowed_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (c, at, turn, chars), and (c, len) of every conversation, turnless ones too.

    Each conversation opens with the first h turns of the first one of its hundred, h from 0 to 5 by its
    id, and goes on with its own turns after its first h.
    """
    own = staged(turns, "turns")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (BORROWED + 1)
    base = F.col("c") - F.col("c") % HUNDRED
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "b": base})
    openings = own.filter(F.col("at") < BORROWED).withColumnRenamed("c", "b")
    held = openings.groupBy("b").agg(F.count(F.lit(1)).alias("n_b"))
    taken = F.least("h", F.coalesce("n_b", F.lit(0)))
    convs = convs.join(held, "b", "left").withColumn("taken", taken)
    convs = staged(convs.select("c", "b", "n", "h", "taken"), "conversations")
    borrowed = convs.filter("taken > 0").join(openings, "b").filter("at < taken")
    # Where the opening lacks turns the rest moves up; a long conversation looks that up in runs.
    shifts = convs.filter("taken < h").select(
        "c", (F.col("h") - F.col("taken")).alias("shift"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / RUN))).alias("run"),
    )
    rest = own.filter(F.col("at") >= h).withColumn("run", F.floor(F.col("at") / RUN))
    rest = rest.join(shifts, ["c", "run"], "left")
    moved = (F.col("at") - F.coalesce("shift", F.lit(0))).alias("at")
    rebuilt = borrowed.select("c", "at", "turn", "chars").unionByName(rest.select("c", moved, "turn", "chars"))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rebuilt, convs.select("c", length.cast("long").alias("len"))


# --- the recursion -------------------------------------------------------------------------


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each k, (low, block, digest) of the whole blocks of 2^k turns."""
    out = [turns.select(F.col("c").alias("low"), F.col("at").alias("block"), F.col("turn").alias("digest"))]
    for _ in range(levels - 1):
        left, right = (F.max(F.when(F.col("block") % 2 == k, F.col("digest"))).alias(f"d{k}") for k in (0, 1))
        pairs = out[-1].groupBy("low", F.shiftright("block", 1).alias("up")).agg(left, right)
        pairs = pairs.filter("d0 is not null and d1 is not null")
        out.append(staged(pairs.select("low", F.col("up").alias("block"), _hashed("d0", "d1").alias("digest")), "blocks"))
    return out


class Level:
    """One round: the nodes at the cuts, the sequences that end there, and the lower edges of the blocks."""

    def __init__(self, parts: DataFrame, blocks: DataFrame, k: int):
        half = 1 << k
        at = parts.filter(F.col("len") >= half).withColumn("block", F.shiftright("start", k))
        named = at.join(blocks, ["low", "block"]).withColumn("node", _hashed("root", "digest"))
        self.named = staged(named.drop("block", "digest"), "named")
        grouped = self.named.groupBy("start", "root", "node")
        self.nodes = staged(grouped.agg(F.min("low").alias("low"), F.sum("n").alias("n")), "nodes").select(
            "node", "root", "low", "n", (F.col("start") + half).alias("depth"), F.lit(k).alias("level"), "start"
        )
        self.ends = self.named.filter((F.col("len") == half) & F.col("edge").isNull()).select(
            "node", F.col("low").alias("c")
        )
        lower = self.named.filter(F.col("len") > half).select(
            (F.col("start") + half).alias("start"), F.col("node").alias("root"), "edge", "low", "n",
            (F.col("len") - half).alias("len"),
        )
        upper = self.nodes.select(
            "start", "root", F.col("node").alias("edge"), "low", "n", F.lit(half).cast("long").alias("len")
        )
        self.edges = lower.filter("edge is not null").select(F.col("root").alias("node"), "edge")
        self.parts = upper.unionByName(lower).unionByName(parts.filter(F.col("len") < half))


def _levels(turns: DataFrame, seqs: DataFrame, count: int) -> list[Level]:
    """The rounds, by k."""
    blocks = _blocks(turns, count)
    parts = seqs.filter("len > 0").select(
        F.lit(0).cast("long").alias("start"), F.lit(ROOT).alias("root"), F.lit(None).cast("binary").alias("edge"),
        F.col("c").alias("low"), F.lit(1).cast("long").alias("n"), "len",
    )
    out = []
    for k in reversed(range(count)):
        out.append(Level(parts, blocks[k], k))
        parts = out[-1].parts
    return out[::-1]


# --- totals --------------------------------------------------------------------------------


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _sums(frame: DataFrame, key: str) -> DataFrame:
    return frame.groupBy(F.col(key).alias("node")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )


def _grafted(frame: DataFrame, more: DataFrame) -> DataFrame:
    added = frame.join(more, "node", "left")
    return added.select(
        *[c for c in frame.columns if c not in ("leaves", "saved")],
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )


def _subtrees(values: DataFrame, levels: list[Level]) -> DataFrame:
    """(node, leaves, saved) summed over subtrees, from (node, root, level, leaves, saved)."""
    local, given = [], []
    for k in range(len(levels)):
        here = values.filter(F.col("level") == k).drop("level")
        if given:
            here = _grafted(here, _sums(_union(given), "root_node"))
        local.append(staged(here, "local"))
        given.append(local[-1].select(F.col("root").alias("root_node"), "leaves", "saved"))
    whole = [values.filter(F.col("level") == -1).select("node", "leaves", "saved")]
    if given:
        whole[0] = _grafted(whole[0], _sums(_union(given).filter(F.col("root_node") == F.lit(ROOT)), "root_node"))
    done: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        here = local[k].select("node", "leaves", "saved")
        if done:
            below = _union(done).withColumnRenamed("node", "edge")
            here = _grafted(here, _sums(levels[k].edges.join(below, "edge"), "node"))
        done.append(staged(here, "whole"))
    return _union([*whole, *done])


# --- ids of equal conversations ------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, c) as texts of at most CHUNK ids."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    node, ids = None, []
    for batch in batches:
        out = []
        for now, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (now != node or len(ids) == CHUNK):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = now
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if ids:
        last = [[node], [ids[0]], [",".join(map(str, ids))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(last, schema)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, first, ids) as one digest per node; only the running hash is kept."""
    node, running = None, None
    for batch in batches:
        out = []
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if now != node:
                if running:
                    out.append((node, running.hexdigest()))
                node, running = now, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["node", "ends"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names=["node", "ends"])


def _end_digests(ends: DataFrame) -> DataFrame:
    by_id = ends.select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c")
    texts = by_id.mapInArrow(_chunks, "node binary, first long, ids string")
    by_node = texts.repartition("node").sortWithinPartitions("node", "first")
    return by_node.mapInArrow(_digests, "node binary, ends string")


# --- the trie ------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row per node of the sequences ``turns`` (c, at, turn, chars) of the members ``seqs`` (c, len).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns, seqs = staged(turns, "rebuilt"), staged(seqs, "members")
    total = seqs.agg(F.max("len").alias("len"), F.min("c").alias("low"), F.count("c").alias("n")).first()
    levels = _levels(turns, seqs, (total.len or 0).bit_length())
    # One row about the whole table, where there is anything in it.
    top = seqs.groupBy().agg(F.min("c").alias("low"), F.count("c").alias("n")).filter("n > 0").select(
        F.lit(ROOT).alias("node"), F.lit(b"").alias("root"), "low", "n",
        F.lit(0).cast("long").alias("depth"), F.lit(-1).alias("level"),
    )
    nodes = _union([top, *[x.nodes.drop("start") for x in levels]])
    if levels:
        odd = levels[0].nodes.select("node", F.col("root").alias("parent"))
        even = levels[0].edges.select(F.col("edge").alias("node"), F.col("node").alias("parent"))
        above = staged(odd.unionByName(even), "parents")
    else:
        above = top.select("node", F.col("root").alias("parent")).limit(0)
    children = above.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    last = turns.select(F.col("c").alias("low"), (F.col("at") + 1).alias("depth"), "chars")
    known = nodes.join(children, "node", "left").join(last, ["low", "depth"], "left")
    values = staged(known.select(
        "node", "root", "level", "low", "n", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        (F.coalesce("chars", F.lit(0)) * (F.col("n") - 1)).alias("saved"),
    ), "values")
    sums = _subtrees(values.select("node", "root", "level", "leaves", "saved"), levels)
    ids = values.select(F.col("node").alias("parent"), F.col("low").alias("parent_conv_id"))
    parents = spread_join(above, "parent", ids, "node").select("node", "parent_conv_id")
    turnless = seqs.filter("len = 0").select(F.lit(ROOT).alias("node"), "c")
    ends = _end_digests(_union([turnless, *[x.ends for x in levels]]))
    whole = values.drop("leaves", "saved").join(sums, "node").join(parents, "node", "left").join(ends, "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text)."""
    return prefix_trie(*with_borrowed_openings(turns_of(rows)))
