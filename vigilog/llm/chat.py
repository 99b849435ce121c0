"""Conversations from reply trees.

Messages name the message they reply to. Pointer doubling by self-joins gives every message the top of its
thread, its depth and the score of the path down to it: after k rounds each row reaches 2^k steps up, so
a thread of any depth takes a logarithmic number of joins. The leaves of a thread are its branches; they are
ranked by path score. The messages of the chosen branches are marked by walking the same pointers from
the largest step to the smallest, and each branch is formatted as one conversation.

The template writes system, user and assistant turns as ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]`` and
``<ASST>text</s>``, any other role as ``[ROLE]role[TEXT]text[/ROLE]``, after ``<s>``. Inside roles and texts
every backslash, ``[`` and ``<`` gets a backslash before it, so no text can hold a marker, and removing those
backslashes restores it. The loss mask is a list of character ranges of the formatted text.

All steps are joins on (tree, node), which spread within a tree, and grouped aggregates; no Python runs.

Defined cases: a null text or role is empty; rows without a tree belong together, to one tree of their own; rows
without a node are left out; a reply to a missing message starts a thread; messages in a cycle have no top and
are left out; of rows that repeat a node the least (parent, role, text) counts once; equal scores
rank by length, then by node; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.session import staged

START = "<s>"
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<ASST>", "</s>"),
}
_OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: An escaped text: no unescaped bracket. Possessive, so that long texts need no backtracking.
_BODY = r"((?:[^\\\[<]++|\\.)*+)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[<])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# --- paths ---------------------------------------------------------------------------------


def _climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each node with its top, depth and path score; and for each k, who is 2^k steps above whom."""
    up = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    at = (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n"))
    first = messages.join(up, at, "left").select(
        "tree", "node", F.col("node").alias("top"), F.col("n").alias("above"),
        F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"),
    )
    now = staged(first, "climb")
    steps, reach, n = [], 1, now.count()
    while True:
        moving = now.filter("above is not null")
        if moving.isEmpty() or reach > n:  # who still moves then is in a cycle
            return now.filter("above is null"), steps
        steps.append(moving.select("tree", "node", "above"))
        far = now.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("top").alias("top2"),
            F.col("above").alias("above2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"),
        )
        moved = moving.join(far, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("n"))).select(
            "tree", "node", F.col("top2").alias("top"), F.col("above2").alias("above"),
            (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"),
        )
        now = staged(now.filter("above is null").unionByName(moved), "climb")
        reach *= 2


def _keyed(messages: DataFrame) -> DataFrame:
    """The tree as a struct, which is never null, so that joins meet rows without a tree as well."""
    return messages.withColumn("tree", F.struct("tree"))


def branches(messages: DataFrame, most: int = 1) -> DataFrame:
    """(tree, top, leaf, rank, node, depth) of every message on the ``most`` best branches of each thread.

    ``messages``: tree, node, parent, score, and what else it may hold.
    """
    found = _branches(_keyed(messages.filter("node is not null")), most)
    return found.withColumn("tree", F.col("tree.tree"))


def _branches(messages: DataFrame, most: int) -> DataFrame:
    """:func:`branches` of messages by :func:`_keyed` trees."""
    known, steps = _climbed(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).filter("node is not null")
    leaves = known.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree", "top").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    marked = chosen.select("tree", "top", F.col("node").alias("leaf"), "rank", "node")
    for step in reversed(steps):
        above = marked.join(step, ["tree", "node"]).drop("node").withColumnRenamed("above", "node")
        marked = marked.unionByName(above)
        marked = staged(marked, "marked")
    return marked.join(known.select("tree", "node", "depth"), ["tree", "node"])


# --- template ------------------------------------------------------------------------------


def turn(role: Column, text: Column) -> Column:
    inner = F.when(F.lit(False), F.lit(""))
    for name, (opened, closed) in MARKS.items():
        inner = inner.when(role == name, F.concat(F.lit(opened), escaped(text), F.lit(closed)))
    opened, between, closed = _OTHER
    return inner.otherwise(
        F.concat(F.lit(opened), escaped(role), F.lit(between), escaped(text), F.lit(closed))
    )


def format_branches(messages: DataFrame, most: int = 1, trained: str = "assistant") -> DataFrame:
    """tree, top, rank, formatted, loss (array of (start, end), code points): one row per branch."""
    rows = _keyed(messages.filter("node is not null")).select(
        "tree", "node", "parent",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    once = rows.groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m")
    )
    once = staged(once.select("tree", "node", "m.*"), "messages")
    chosen = _branches(once.select("tree", "node", "parent", "score"), most)
    opened = len(MARKS[trained][0])
    closed = len(MARKS[trained][1])
    turns = chosen.join(once.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "top", "rank", "depth",
        F.struct("depth", (F.col("role") == trained).alias("is_trained"), turn(F.col("role"), F.col("text")).alias("out")).alias("turn"),
    )
    grouped = turns.groupBy("tree", "top", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.expr(
        f"aggregate(turns, named_struct('at', {len(START)}, 'spans', cast(array() as array<struct<start:int,end:int>>)), "
        "(acc, t) -> named_struct('at', acc.at + length(t.out), 'spans', "
        f"if(t.is_trained, concat(acc.spans, array(named_struct('start', acc.at + {opened}, 'end', acc.at + length(t.out) - {closed}))), acc.spans))).spans"
    )
    return grouped.select(
        "tree.tree", "top", "rank",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["out"]), "")).alias("formatted"),
        loss.alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Back from the text: array of (role, text)."""
    known = [
        f"{_quoted(a)}{_BODY}{_quoted(b)}" for a, b in MARKS.values()
    ] + [f"{_quoted(_OTHER[0])}{_BODY}{_quoted(_OTHER[1])}{_BODY}{_quoted(_OTHER[2])}"]
    pattern = F.lit("(?s)" + "|".join(known))

    def group(k: int) -> Column:
        return F.regexp_extract_all(formatted, pattern, F.lit(k))

    whole = group(0)
    columns = [whole, *(group(k) for k in range(1, 6))]
    names = ["whole", "system", "user", "assistant", "role", "other"]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(columns, names, strict=True)])

    def one(z: Column) -> Column:
        role, text = unescaped(z["role"]), z["other"]
        for name, (opened, _) in MARKS.items():
            mine = F.startswith(z["whole"], F.lit(opened))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, z[name]).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(zipped, one)


def _quoted(mark: str) -> str:
    return "".join("\\" + c if c in "[]" else c for c in mark)


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped."""
    parts = F.transform(
        loss, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])
    )
    return F.array_join(F.transform(parts, unescaped), "")


# --- linear conversations ------------------------------------------------------------------


def as_tree(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A conversation by turns as a tree with one branch. Equal rows follow one another."""
    order = Window.partitionBy("tree").orderBy("at", "role", "text")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).cast("long").alias("at"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    node = F.row_number().over(order).cast("long")
    return rows.withColumn("node", node).select(
        "tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def conversation_report(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        read_turns(F.col("formatted")).alias("turns"),
        masked(F.col("formatted"), F.col("loss")).alias("masked"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )
