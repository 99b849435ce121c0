"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum, which combines on the map side, and a join whose skewed keys adaptive
execution splits. Each round's edges are a table in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or the smaller) neighbours of each node to the least of them all."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges  # a > b: only the smaller neighbours
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _sum(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node."""
    now = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = staged(now.distinct(), "edges")
    before = _sum(now)
    while before[0]:
        now = staged(_star(_star(now, True).distinct(), False).distinct(), "edges")
        after = _sum(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
