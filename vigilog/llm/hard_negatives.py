"""Hard negatives by segment summaries.

A vector is cut into 1, 2, 4 and 8 segments, and each segment's mean and deviation (the root of the summed squares
of the differences from the mean) are stored with it. The inner product of two vectors over a segment of length l lies
within l * mean * mean' plus or minus deviation * deviation', so the sums over all segments bound the whole product.
Pairs are refined from one segment to eight, and only pairs whose bounds still reach the wanted range are scored
exactly. For positives the range is everything above the anchor's fifth best so far, for negatives from half the
positive's score to 95 % of it, above the third best so far.

How it scales: anchors, a stated query set, are taken in blocks of bounded size, and each block goes to
the tasks that read the table: two scans a block, one for positives and one for negatives. A task keeps the best few rows
per anchor and nothing else, so a hot label or a vector that fills a third of the table costs no more than others, and
tasks are as many as the cores, so what they return grows with the anchors alone.

Defined cases: rows without an id take no part, nor do those that the contract names; shorter vectors count as padded with
zeros; a vector that has no component scores 0 with everything; rows that repeat an id are all candidates and,
as anchors, are mined one by one, but never pair with a row of their own id; an empty table gives an
empty result. Scores are exact while sums stay below 2^53 in floating point, or 2^63 in integers,
which are used beyond. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.session import staged

SCALE = 256
EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of its positive's.
LEAST, MOST = 50, 95
SEGMENTS = (1, 2, 4, 8)
#: Anchors that go to the tasks at a time.
BLOCK = 4096
#: Anchors and rows that are compared at a time; the first rows come in few, to find good bounds early.
ANCHORS, ROWS, FIRST_ROWS = 512, 2048, 64
#: Below this share of remaining pairs each pair is refined on its own.
SPARSE = 0.2
EXACT = float(1 << 53)


# --- vectors and summaries -----------------------------------------------------------------


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of one width, cut or padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = at < width
    out[row[held], at[held]] = values[held]
    return out


def _summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments, coarse ones first."""
    means, deviations = [], []
    for count in SEGMENTS:
        cut = vectors.reshape(len(vectors), count, -1).astype(np.float64)
        mean = cut.mean(2)
        means.append(mean)
        deviations.append(np.sqrt(((cut - mean[:, :, None]) ** 2).sum(2)))
    return np.hstack(means), np.hstack(deviations)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, rows.reshape(-1))


def _prepared(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column(2), width)
        means, deviations = _summaries(vectors)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _lists(vectors), _lists(means), _lists(deviations)],
            names=["vec_id", "label", "vector", "means", "deviations"],
        )


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, in whole numbers, with the contract's labels."""
    number = F.col(id_col).cast("long")
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(number % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))
    kept = rows.filter(number.isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return kept.select(number.alias("vec_id"), moved.cast("long").alias("label"), whole.alias("vector"))


def summarised(vectors: DataFrame) -> DataFrame:
    """The vectors as a table, of one width, with the means and deviations of their segments."""
    widest = vectors.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    width = max(1, -(-widest // SEGMENTS[-1])) * SEGMENTS[-1]
    made = vectors.mapInArrow(
        partial(_prepared, width),
        "vec_id long, label long, vector array<long>, means array<double>, deviations array<double>",
    )
    return staged(made, "summaries")


@dataclass
class Vectors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, width: int | None = None) -> Vectors:
        ids, labels = (batch.column(k).to_numpy() for k in (0, 1))
        first = batch.column(2)
        if width is None:
            width = len(first[0]) if len(first) else SEGMENTS[-1]
        n = sum(SEGMENTS)
        return cls(ids, labels, _matrix(first, width), _matrix(batch.column(3), n), _matrix(batch.column(4), n))

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.vectors[at], self.means[at], self.deviations[at])


# --- comparing -----------------------------------------------------------------------------


def _scored(
    anchors: Vectors, rows: Vectors, wanted: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted pairs whose score lies from ``low`` to ``high`` of the anchor."""
    mask = wanted.copy()
    width = anchors.vectors.shape[1]
    size = [float(np.abs(v.vectors).max(initial=0)) for v in (anchors, rows)]
    exact = size[0] * size[1] * width < EXACT
    slack = 1e-9 * size[0] * size[1] * width + 1e-6
    start = 0
    for count in SEGMENTS if exact else ():
        here = slice(start, start + count)
        start += count
        length = width // count
        am, ad, rm, rd = (x[:, here] for x in (anchors.means, anchors.deviations, rows.means, rows.deviations))
        if np.count_nonzero(mask) > SPARSE * mask.size:
            centre, spread = (am * length) @ rm.T, ad @ rd.T + slack
            mask &= (centre + spread >= low[:, None]) & (centre - spread <= high[:, None])
        else:
            a, r = np.nonzero(mask)
            centre = np.einsum("ij,ij->i", am[a] * length, rm[r])
            spread = np.einsum("ij,ij->i", ad[a], rd[r]) + slack
            gone = (centre + spread < low[a]) | (centre - spread > high[a])
            mask[a[gone], r[gone]] = False
    a, r = np.nonzero(mask)
    kind = np.float64 if exact else np.int64
    av, rv = anchors.vectors.astype(kind), rows.vectors.astype(kind)
    if len(a) > SPARSE * mask.size:
        scores = (av @ rv.T)[a, r]
    else:
        scores = np.einsum("ij,ij->i", av[a], rv[r])
    scores = scores.astype(np.int64)
    held = (scores >= low[a]) & (scores <= high[a])
    return a[held], r[held], scores[held]


@dataclass
class Best:
    """The first few rows of each slot: higher scores first, then smaller ids."""

    most: int
    slot: np.ndarray
    score: np.ndarray
    number: np.ndarray
    count: int

    @classmethod
    def none(cls, slots: int, most: int) -> Best:
        empty = np.zeros(0, np.int64)
        return cls(most, empty, empty, empty, slots)

    def add(self, slot: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        slot, score, number = (np.concatenate(p) for p in (
            (self.slot, slot), (self.score, score), (self.number, number)
        ))
        order = np.lexsort((number, -score, slot))
        slot, score, number = slot[order], score[order], number[order]
        first = np.searchsorted(slot, slot)
        held = np.arange(len(slot)) - first < self.most
        self.slot, self.score, self.number = slot[held], score[held], number[held]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Score and id that a row must beat, for each slot; a full slot's last row."""
        score = np.full(self.count, np.iinfo(np.int64).min)
        number = np.full(self.count, np.iinfo(np.int64).max)
        last = np.searchsorted(self.slot, np.arange(self.count), side="right") - 1
        full = np.bincount(self.slot, minlength=self.count) >= self.most
        score[full], number[full] = self.score[last[full]], self.number[last[full]]
        return score, number

    def batch(self, keys: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[self.slot]), pa.array(ranks[self.slot]), pa.array(self.number), pa.array(self.score)],
            names=["anchor", "rank", "vec_id", "score"],
        )


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Vectors]:
    """The rows of a task, in pieces that grow."""
    size = FIRST_ROWS
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            yield Vectors.of(batch.slice(start, size), width)
            start += size
            size = min(ROWS, size * 4)


def _mined(
    anchors: Vectors,
    unit: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    ranks: np.ndarray,
    same: bool,
    most: int,
    batches: Iterator[pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """The best rows of the task for each unit: an anchor (``unit``) with a range of scores.

    ``same`` takes the rows of the anchor's label, else the others. Units are sorted by anchor.
    """
    width = anchors.vectors.shape[1]
    parts = []
    for start in range(0, len(anchors.ids), ANCHORS):
        first, last = np.searchsorted(unit, [start, start + ANCHORS])
        if last > first:
            parts.append((anchors.take(slice(start, start + ANCHORS)), unit[first:last] - start, slice(first, last),
                          Best.none(last - first, most)))
    for rows in _pieces(batches, width):
        for some, units, where, best in parts:
            wanted = (some.labels[:, None] == rows.labels[None, :]) == same
            wanted &= some.ids[:, None] != rows.ids[None, :]
            bound, number = best.bounds()
            least = np.maximum(low[where], bound)
            # The widest range of any unit of the anchor; none for an anchor without units.
            lows = np.full(len(some.ids), np.iinfo(np.int64).max)
            highs = np.full(len(some.ids), np.iinfo(np.int64).min)
            np.minimum.at(lows, units, least)
            np.maximum.at(highs, units, high[where])
            wanted &= (lows <= highs)[:, None]
            a, r, score = _scored(some, rows, wanted, lows, highs)
            if not len(a):
                continue
            # Each found pair goes to the anchor's units whose range holds it.
            begin, end = np.searchsorted(units, a), np.searchsorted(units, a, side="right")
            pair = np.repeat(np.arange(len(a)), end - begin)
            slot = np.arange(len(pair)) - np.repeat(np.cumsum(end - begin) - (end - begin) - begin, end - begin)
            score, found = score[pair], rows.ids[r[pair]]
            held = (score >= low[where][slot]) & (score <= high[where][slot])
            held &= (score > bound[slot]) | ((score == bound[slot]) & (found < number[slot]))
            best.add(slot[held], score[held], found[held])
    for _, _, where, best in parts:
        if len(best.slot):
            yield best.batch(unit[where], ranks[where])


FOUND = "anchor long, rank int, vec_id long, score long"


def _best(table: DataFrame, mine, most: int, keys: list[str]) -> DataFrame:
    """The best of what all tasks found: a handful of rows per key and task."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    found = table.coalesce(cores).mapInArrow(mine, FOUND)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)


def _block(table: DataFrame, anchors: Vectors, number: int) -> DataFrame:
    """The hard negatives of one block of anchors."""
    n = len(anchors.ids)
    key = np.arange(n)
    widest = np.iinfo(np.int64)
    none = np.zeros(n, np.int32)
    mine = partial(_mined, anchors, key, np.full(n, widest.min), np.full(n, widest.max), none, True, POSITIVES)
    first = _best(table, mine, POSITIVES, ["anchor"])
    positives = staged(first.select(
        "anchor", F.col("at").cast("int").alias("rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ), "positives")
    known = positives.select("anchor", "rank", "positive_score").orderBy("anchor", "rank").toArrow()
    unit, ranks, score = (known.column(k).to_numpy() for k in range(3))
    low, high = -((-LEAST * score) // 100), (MOST * score) // 100
    mine = partial(_mined, anchors, unit, low, high, ranks, False, NEGATIVES)
    last = _best(table, mine, NEGATIVES, ["anchor", "rank"]).select(
        "anchor", "rank", F.col("at").cast("int").alias("place"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    ids = table.sparkSession.createDataFrame(
        [(k, int(x)) for k, x in enumerate(anchors.ids)], "anchor long, anchor_id long"
    )
    whole = positives.join(last, ["anchor", "rank"]).join(ids, "anchor")
    return staged(whole.select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score"
    ), f"negatives-{number}")


def hard_negatives(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive.

    Anchors are the rows whose id ``every`` divides.
    """
    table = summarised(quantised(rows))
    asked = table.filter(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() // BLOCK)
    out = []
    for k in range(max(1, blocks)):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))) == k)
        out.append(_block(table, Vectors.of(some.orderBy("vec_id", "label").toArrow()), k))
    return reduce(DataFrame.unionByName, out)
