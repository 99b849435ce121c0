"""Benchmark decontamination: a broadcast set of hashed test windows, scanned over training text.

A window is ``width`` consecutive words of a benchmark item (all of them for a shorter item). Each task
reduces its texts to words joined by single spaces, takes the hash of every word window from one
running sum over the bytes, looks the hashes up in a sorted array, and confirms each hit on the bytes.

The set is broadcast, so its size is proven first: items are counted in bytes and dealt into as many
blocks as keep each at ``block_bytes`` on average. A block is sent as its words and 24 bytes a window in sorted
arrays: 16 MiB of text are at most 16 MiB of words and, at the shortest words, 8 Mi windows; English text has about
six bytes a word and takes 85 MiB. Each block is broadcast in turn to a scan of its own, whose finds are written
before the next block is read; what the scans find in one document is merged by document. One block, the usual case,
needs no shuffle at all.

Defined cases: a null or empty text has no words and is never contaminated; an item without words has
no window; repeated rows are judged each alone; equal item ids are counted once; the text of an item without an id
hits, but is not listed among the items; an empty benchmark
hits nothing. Long texts are processed in pieces that overlap by a window. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import RangeHash, id_and_bytes, slices
from vigilog.session import staged

WIDTH = 13
#: Most bytes of benchmark text in one broadcast set.
BLOCK_BYTES = 16 << 20
#: Bytes of text hashed at a time in a task.
PIECE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("0") : ord("9") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True

_FOUND = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


def words_of(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each starts and ends."""
    raw = np.frombuffer(data.lower(), np.uint8)
    letter = _LETTER[raw]
    if not letter.any():
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(len(raw), bool)
    before[1:] = letter[:-1]
    first, stop = letter & ~before, before & ~letter
    joined = np.where(letter, raw, np.uint8(32))[letter | stop]
    starts = np.flatnonzero(first[letter | stop])
    ends = np.flatnonzero(joined == 32)
    if len(ends) < len(starts):
        ends = np.append(ends, len(joined))
    return joined.tobytes(), starts, ends


class Windows:
    """The windows of a block of items: sorted hashes, and where in the block's words one of each lies.

    Arrays only, 24 bytes a window beside the words, so that a block has a known size in every worker. Windows of
    other bytes that share a hash, practically none, are kept by their bytes.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], width: int):
        self.ids = np.array(sorted({item for item, _ in items if item is not None}), np.int64)
        number = {item: k for k, item in enumerate(self.ids.tolist())}
        parts, offset = [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for item, text in items:
            joined, starts, ends = words_of(text or b"")
            if not len(starts):
                continue
            size = min(width, len(starts))
            a, b = starts[: len(starts) - size + 1], ends[size - 1 :]
            hashes = RangeHash(np.frombuffer(joined, np.uint8)).of(a, b)
            owner = np.full(len(a), number.get(item, -1), np.int32)
            found[size].append((hashes, (a + offset).astype(np.int32), (b + offset).astype(np.int32), owner))
            parts.append(joined)
            offset += len(joined)
        self.words = b"".join(parts)
        self.sizes = {
            size: self._indexed(*(np.concatenate(c) for c in zip(*rows, strict=True)))
            for size, rows in found.items()
        }

    def _indexed(self, hashes: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> tuple:
        """(hashes, start, end, first owner, owners, windows by (hash, bytes) that share a hash)."""
        order = np.lexsort((owner, hashes))
        hashes, a, b, owner = hashes[order], a[order], b[order], owner[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        first = np.flatnonzero(new)
        lead = first[np.cumsum(new) - 1]
        other: dict[tuple[int, bytes], set[int]] = defaultdict(set)
        same = np.ones(len(hashes), bool)
        for i in np.flatnonzero(~new).tolist():
            window = self.words[a[i] : b[i]]
            if window != self.words[a[lead[i]] : b[lead[i]]]:
                same[i] = False
                other[int(hashes[i]), window].add(int(owner[i]))
        group, owner = (np.cumsum(new) - 1)[same & (owner >= 0)], owner[same & (owner >= 0)]
        once = np.ones(len(group), bool)
        once[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
        stops = np.searchsorted(group[once], np.arange(len(first) + 1)).astype(np.int32)
        return hashes[first], a[first], b[first], stops, owner[once], dict(other)

    @property
    def nbytes(self) -> int:
        arrays = sum(c.nbytes for index in self.sizes.values() for c in index[:5])
        return arrays + len(self.words) + self.ids.nbytes

    def hits(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """(first word, words, items) of every window that occurs, in no order."""
        if not len(starts) or not self.sizes:
            return
        ranges = RangeHash(np.frombuffer(joined, np.uint8))
        for size, (known, start, end, first, owners, other) in self.sizes.items():
            if size > len(starts):
                continue
            a, b = starts[: len(starts) - size + 1], ends[size - 1 :]
            got = ranges.of(a, b)
            at = np.searchsorted(known, got)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == got).tolist():
                k, window = at[i], joined[a[i] : b[i]]
                if window == self.words[start[k] : end[k]]:
                    yield i, size, self.ids[owners[first[k] : first[k + 1]]].tolist()
                elif (mine := other.get((int(got[i]), window))) is not None:
                    yield i, size, [int(self.ids[o]) for o in mine if o >= 0]


def _pieces(data: bytes, width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """Word pieces of one text with the number of words before each; pieces overlap by width - 1."""
    start, done, keep = 0, 0, b""
    while start < len(data):
        stop = min(len(data), start + PIECE)
        while stop < len(data) and _LETTER[data[stop]] | (65 <= data[stop] <= 90):
            stop += 1
        joined, starts, ends = words_of(keep + b" " + data[start:stop])
        yield joined, starts, ends, done
        carried = min(len(starts), width - 1)
        done += len(starts) - carried
        keep = joined[starts[-carried] :] if carried else b""
        start = stop


def _scan_one(data: bytes, windows: Windows, width: int) -> tuple[int, list, set[int]]:
    spans, items, n = [], set(), 0
    for joined, starts, ends, before in _pieces(data, width):
        n = before + len(starts)
        for i, size, got in windows.hits(joined, starts, ends):
            spans.append((before + i, before + i + size))
            items.update(got)
    return n, merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan_many(texts: list[bytes], windows: Windows, width: int) -> list[tuple]:
    """Like ``_scan_one`` for short texts, which are hashed together."""
    parts = [words_of(t) for t in texts]
    offset, at, joined = 0, [], []
    for text, _, _ in parts:
        at.append(offset)
        joined.append(text)
        offset += len(text) + 1
    counts = np.array([len(p[1]) for p in parts])
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.concatenate([p[1] + a for p, a in zip(parts, at, strict=True)])
    ends = np.concatenate([p[2] + a for p, a in zip(parts, at, strict=True)])
    # Texts are kept apart by a byte that no word holds, so no window crosses from one to the next.
    spans, items = defaultdict(list), defaultdict(set)
    for i, size, got in windows.hits(b"\n".join(joined), starts, ends):
        doc = int(np.searchsorted(first, i, "right")) - 1
        spans[doc].append((i - first[doc], i - first[doc] + size))
        items[doc].update(got)
    return [(int(n), merged(spans[k]), items[k]) for k, n in enumerate(counts)]


def _scan(batches: Iterator[pa.RecordBatch], windows: Windows, width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("row", pa.int64()),
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.list_(pa.int64()))),
            ("items", pa.list_(pa.int64())),
        ]
    )
    for batch in batches:
        texts = batch.column(2).to_pylist()
        found: list[tuple] = []
        for i, j in slices([len(t) for t in texts], PIECE):
            if j == i + 1 and len(texts[i]) > PIECE:
                found.append(_scan_one(texts[i], windows, width))
            else:
                found += _scan_many(texts[i:j], windows, width)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([[[int(x) for x in r] for r in f[1]] for f in found], schema.field(3).type),
                pa.array([sorted(f[2]) for f in found], schema.field(4).type),
            ],
            schema=schema,
        )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, runs (first word, word after the last), items (sorted ids)."""
    spark = docs.sparkSession
    tests = benchmark.select(
        F.col(item_col).cast("long").alias("item"),
        F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("text"),
    )
    size = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows = id_and_bytes(docs, id_col, text_col)
    if blocks > 1:
        # Rows must keep their number over several scans, so they are numbered once, in a table.
        rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    else:
        rows = rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    scans = []
    for k in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        windows = spark.sparkContext.broadcast(
            Windows([(r["item"], bytes(r["text"])) for r in part.toLocalIterator()], width)
        )
        scan = rows.mapInArrow(lambda batches, w=windows: _scan(batches, w.value, width), _FOUND)
        if blocks > 1:
            scan = staged(scan, "scan")
            windows.unpersist()
        scans.append(scan)
    found = scans[0]
    if blocks > 1:
        for scan in scans[1:]:
            found = found.unionByName(scan)
        lists = found.groupBy("row", "doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        # Runs of several blocks may overlap: extend the last one or start another.
        join_runs = (
            "aggregate(runs, cast(array() as array<array<bigint>>), (acc, r) -> "
            "CASE WHEN size(acc) > 0 AND r[0] <= element_at(acc, -1)[1] "
            "THEN concat(slice(acc, 1, size(acc) - 1), "
            "array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], r[1])))) "
            "ELSE concat(acc, array(r)) END)"
        )
        found = lists.withColumn("runs", F.expr(join_runs))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "runs", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Whole documents go where a twentieth of the words or more is benchmark text."""
    report = contamination_report(docs, benchmark, **options)
    bad = report.filter("contaminated").select(F.col("doc_id").alias("__bad"))
    key = options.get("id_col", "doc_id")
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad["__bad"]), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id and text without the words that a benchmark window covers."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    runs = find_contamination(docs, benchmark, **options).filter("n_hit > 0")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = runs.groupBy("doc_id").agg(F.max("runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if t is None or r is None else _without(t.encode(), r)
                for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    joined = rows.join(runs, rows["doc_id"].eqNullSafe(runs["doc_id"]), "left")
    return joined.select(rows["doc_id"], "text", "runs").mapInArrow(cut, "doc_id long, text string")


def _without(data: bytes, runs: list[list[int]]) -> str:
    letter = _LETTER[np.frombuffer(data.lower(), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    out, last = [], 0
    for a, b in runs:
        out.append(data[last : edge[2 * a]])
        last = edge[2 * b - 1]
    return b"".join([*out, data[last:]]).decode()
