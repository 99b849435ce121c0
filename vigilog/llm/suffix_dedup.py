"""Exact substring dedup with a sparse suffix array.

Every byte that lies in a string of ``LENGTH`` bytes which also starts elsewhere is to go. Equal windows of
that length choose the same anchor in themselves, the position of their least 32-byte hash, so windows need
to be compared only within suffixes that start at anchors, about one for every 180 bytes. Each window
belongs to just one anchor; an anchor with its windows is a segment.

1. Segments are reduced to hashes of their anchor and of their bytes. Where nobody else has the anchor,
   nothing repeats. Segments that are equal as a whole repeat as a whole and need one representative.
2. Only representatives whose anchor has several different segments, the edges of repeats, are read again as bytes.
   Their suffixes are range-partitioned by their leading bytes with sampled splitters. Each bucket sorts
   them by multikey quicksort (eight bytes a key, only ties go on), to the right of the anchor and to its left,
   and compares neighbours: two segments share the window that begins t bytes before the anchor when they
   agree on t bytes to the left and ``LENGTH`` - t to the right. Equal leading bytes never straddle a boundary.
3. An anchor with more different segments than ``GROUP`` would fill one bucket. Its windows are hashed to 128
   bits and counted by Spark instead, combined on the map side: whole results, no bucket at all.

How it scales: the text is shuffled twice, by document; everything else that moves is an edge or a
fixed-size row per segment. Hot passages are one row per map task, since equal segments are merged first.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; matches may overlap and may lie
in one document; rows repeated whole count as separate places and so lose their repeated bytes; an
empty table gives an empty result. Texts are hashed in pieces, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import RangeHash, id_and_text
from vigilog.session import staged

LENGTH = 400
GRAM = 32
#: Windows of a text that are hashed at a time.
PIECE = 1 << 17
_PLACE_BITS = np.uint64(18)  # a piece and one window fit
#: Segments of one anchor that a bucket compares, and segments it holds at a time.
GROUP = 20_000
BLOCK = 20_000


# --- anchors -------------------------------------------------------------------------------


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, in two passes."""
    n = len(x) - width + 1
    full = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)])
    blocks = full.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, anchor, hash of the anchor) along a text."""
    total, width = len(data) - length + 1, length - gram + 1
    held: tuple[int, int, int, int] | None = None
    for start in range(0, max(total, 0), PIECE):
        n = min(PIECE, total - start)
        piece = np.frombuffer(data, np.uint8, n + length - 1, start)
        places = np.arange(n + width - 1)
        grams = RangeHash(piece).of(places, places + gram)
        keyed = (grams >> _PLACE_BITS << _PLACE_BITS) | places.astype(np.uint64)
        anchor = (_sliding_least(keyed, width) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        counts = np.diff(np.append(first, n))
        marks = grams[anchor[first]].view(np.int64)
        for lo, many, at, mark in zip(
            (first + start).tolist(), counts.tolist(), (anchor[first] + start).tolist(), marks.tolist(), strict=True
        ):
            if held and held[2] == at:  # a piece ended among the windows of this anchor
                held = (held[0], held[1] + many, at, mark)
                continue
            if held:
                yield held
            held = (lo, many, at, mark)
    if held:
        yield held


_SEGMENT = "doc_id long, th long, lo long, n int, back int, mark long, same long"


def _marked(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    names = ["doc_id", "th", "lo", "n", "back", "mark", "same"]
    for batch in batches:
        for doc, th, text in zip(*(c for c in batch.columns), strict=True):
            data, doc, th = text.as_py(), doc.as_py(), th.as_py()
            rows = list(segments(data, length, gram))
            if not rows:
                continue
            lo, n, at, mark = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            same = [
                digest(data[a : a + k + length - 1], p - a)
                for a, k, p in zip(lo.tolist(), n.tolist(), at.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc] * len(rows), pa.int64()),
                    pa.array([th] * len(rows), pa.int64()),
                    pa.array(lo),
                    pa.array(n.astype(np.int32)),
                    pa.array((at - lo).astype(np.int32)),
                    pa.array(mark),
                    pa.array(np.array(same, np.uint64).view(np.int64)),
                ],
                names=names,
            )


# --- a bucket ------------------------------------------------------------------------------


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes big-endian words have in common."""
    x = a ^ b
    return sum(((x >> np.uint64(s)) == 0).astype(np.int64) for s in range(0, 64, 8))


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows, and how many leading bytes each shares with the one before it in order.

    One eight-byte key at a time: rows are split into less, equal and greater within their group, and only
    those still tied go on to the next key.
    """
    m, width = rows.shape
    words = rows.view(">u8").astype(np.uint64)
    order, shared = np.arange(m), np.zeros(m, np.int64)
    tied, group = np.arange(m), np.zeros(m, np.int64)
    for d in range(width // 8):
        word = words[order[tied], d]
        by = np.lexsort((word, group))
        order[tied] = order[tied][by]
        word = word[by]
        inside = np.concatenate([[False], group[1:] == group[:-1]])
        differs = np.concatenate([[True], word[1:] != word[:-1]])
        split = np.flatnonzero(inside & differs)
        shared[tied[split]] = 8 * d + _shared_bytes(word[split - 1], word[split])
        parts = np.cumsum(~inside | differs)
        more = np.bincount(parts)[parts] > 1
        tied, group = tied[more], parts[more]
        if not len(tied):
            return order, shared
    shared[tied[1:][group[1:] == group[:-1]]] = width
    return order, shared


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    width += -width % 8
    rows = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8)
    return rows.reshape(len(parts), width), np.array([len(p) for p in parts])


def _ordered(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    rows, sizes = _padded(parts, width)
    order, shared = multikey_sort(rows)
    sizes = sizes[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    return order, shared


def repeated_windows(found: list[tuple[bytes, int, int]], length: int, gram: int) -> np.ndarray:
    """For segments (bytes, windows, bytes before the anchor): which windows also occur in another one.

    Column t stands for the window that begins t bytes before the anchor.
    """
    m, most = len(found), length - gram + 1
    back = np.array([b for _, _, b in found])
    windows = np.array([n for _, n, _ in found])
    right, right_shared = _ordered([s[b:] for s, _, b in found], length)
    left, left_shared = _ordered([s[:b][::-1] for s, _, b in found], max(most, 8))
    out = np.zeros((m, most), bool)
    part_right, part_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for t in range(most):
        mine = np.flatnonzero((t <= back) & (t > back - windows))
        if len(mine) < 2:
            continue
        part_right[right] = np.cumsum(right_shared < length - t)
        part_left[left] = np.cumsum(left_shared < t)
        pair = part_right[mine] * (m + 1) + part_left[mine]
        by = np.argsort(pair)
        equal = pair[by][1:] == pair[by][:-1]
        out[mine[by[1:][equal]], t] = True
        out[mine[by[:-1][equal]], t] = True
    return out


_RUNS = "mark long, same long, runs array<array<long>>"


def _runs(windows: np.ndarray) -> list[list[int]]:
    """Runs of consecutive numbers, as (first, last)."""
    cut = np.flatnonzero(np.diff(windows) > 1)
    return np.stack([windows[np.append(0, cut + 1)], windows[np.append(cut, len(windows) - 1)]], 1).tolist()


def _bucket(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Segments of whole anchors, sorted by their leading bytes, in blocks that fit."""

    def blocks() -> Iterator[list[tuple]]:
        held: dict[tuple, tuple] = {}
        lead = None
        for batch in batches:
            for now, mark, same, n, back, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != lead and len(held) >= BLOCK:
                    yield list(held.values())
                    held = {}
                lead = now
                held[mark, same] = (mark, same, n, back, data)
        if held:
            yield list(held.values())

    for rows in blocks():
        repeated = repeated_windows([(data, n, back) for _, _, n, back, data in rows], length, gram)
        out = []
        for i in np.flatnonzero(repeated.any(1)).tolist():
            mark, same, _, back, _ = rows[i]
            out.append((mark, same, _runs(np.sort(back - np.flatnonzero(repeated[i])))))
        if out:
            mark, same, runs = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mark, pa.int64()),
                    pa.array(same, pa.int64()),
                    pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                ],
                names=["mark", "same", "runs"],
            )


# --- the job -------------------------------------------------------------------------------


def _cut_out(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data, rows = text.as_py(), wanted.as_py()
            parts = [data[w["lo"] : w["lo"] + w["n"] + length - 1] for w in rows]
            leads = [p[w["back"] : w["back"] + gram] for p, w in zip(parts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(leads, pa.binary()),
                    pa.array([w["mark"] for w in rows], pa.int64()),
                    pa.array([w["same"] for w in rows], pa.int64()),
                    pa.array([w["n"] for w in rows], pa.int32()),
                    pa.array([w["back"] for w in rows], pa.int32()),
                    pa.array(parts, pa.binary()),
                    pa.array([w["kinds"] for w in rows], pa.int64()),
                ],
                names=["lead", "mark", "same", "n", "back", "data", "kinds"],
            )


def _hashed_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for mark, same, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = [digest(data[i : i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([mark] * n, pa.int64()),
                    pa.array([same] * n, pa.int64()),
                    pa.array(range(n), pa.int64()),
                    pa.array(hashes, pa.binary()),
                ],
                names=["mark", "same", "i", "hash"],
            )


def _keep(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    digest, last, removed, runs = hashlib.sha256(), 0, 0, 0
    for a, b in spans:
        digest.update(data[last:a])
        last, removed, runs = b, removed + b - a, runs + 1
    digest.update(data[last:])
    return len(data), removed, runs, digest.hexdigest()


def union(spans: list[list[int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            _keep(t.as_py(), union(s.as_py()))
            for t, s in zip(batch.column(1), batch.column(2), strict=True)
        ]
        n, removed, runs, digest = zip(*rows, strict=True) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(digest, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def _same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, th, spans) of each text with repeats: byte ranges, which may overlap. th: xxhash64 of the text."""
    texts = _texts(docs, id_col, text_col)
    marked = staged(texts.mapInArrow(lambda b: _marked(b, length, gram), _SEGMENT), "segments")
    often = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("places")).filter("places > 1")
    marked = staged(marked.join(often.select("mark"), "mark"), "shared")
    seen = marked.groupBy("mark", "same").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("doc_id", "th", "lo", "n", "back")).alias("head")
    )
    seen = staged(seen, "kinds")
    kinds = seen.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    edges = seen.join(kinds, "mark").select("head.*", "mark", "same", "kinds")
    wanted = edges.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("lo", "n", "back", "mark", "same", "kinds")).alias("wanted")
    )
    read = texts.join(wanted, _same_text(texts, wanted)).select(texts["text"], "wanted")
    read = staged(
        read.mapInArrow(
            lambda b: _cut_out(b, length, gram),
            "lead binary, mark long, same long, n int, back int, data binary, kinds long",
        ),
        "edges",
    )
    dealt = read.filter(F.col("kinds") <= group).drop("kinds")
    dealt = dealt.repartitionByRange("lead").sortWithinPartitions("lead")
    runs = dealt.mapInArrow(lambda b: _bucket(b, length, gram), _RUNS)
    hot = read.filter(F.col("kinds") > group).dropDuplicates(["mark", "same"])
    hashed = hot.select("mark", "same", "n", "data").mapInArrow(
        lambda b: _hashed_windows(b, length), "mark long, same long, i long, hash binary"
    )
    twice = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("places")).filter("places > 1")
    counted = hashed.join(twice.select("hash"), "hash").groupBy("mark", "same")
    runs = runs.unionByName(
        counted.agg(F.collect_list(F.array("i", "i")).alias("runs"))
    )
    whole = seen.filter("places > 1").select(
        "mark", "same", F.array(F.array(F.lit(0).cast("long"), F.col("head.n").cast("long") - 1)).alias("runs")
    )
    rest = runs.join(whole.select("mark", "same"), ["mark", "same"], "left_anti")
    covered = staged(whole.unionByName(rest), "covered")
    placed = marked.join(covered, ["mark", "same"]).select(
        "doc_id", "th",
        F.transform("runs", lambda r: F.array(F.col("lo") + r[0], F.col("lo") + r[1] + length)).alias("spans"),
    )
    return placed.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removal_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(docs, id_col, text_col, length, gram, group)
    texts = _texts(docs, id_col, text_col)
    joined = texts.join(spans, _same_text(texts, spans), "left")
    return joined.select(texts["doc_id"], "text", "spans").mapInArrow(
        _reported, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
