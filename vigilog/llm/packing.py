"""Best-fit packing by minimum bin slack.

Documents become token ids, a document that exceeds a sequence is cut into full pieces (the first one takes
the remainder), and the pieces are packed. Only how many pieces there are of each length matters for that,
at most ``SIZE`` numbers. For every bin, the longest piece left is taken and a bitset of reachable sums
over the lengths left finds the fullest feasible combination, which is removed. A combination is removed as
often as the counts allow at once, so the plan depends on the number of lengths, not of documents.

Then every piece needs its rank among those of its length: ranks are counted within hash groups of bounded
size and shifted by the groups before, so that no length, not even one that a third of all pieces has,
meets in one task. Rank and length give the sequence and the place in it.

Defined cases: a null or empty text is one end token; equal rows are packed each; an empty table gives an
empty result; a text of any length is tokenised whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import id_and_text
from vigilog.session import staged

SIZE = 2048
END = 0
#: Pieces per hash group that are ranked together, about.
GROUP = 20_000


#: Texts of these characters only are cut into words alike by every regular-expression engine.
_COMMON = re.compile(r"[ -~\t\n\rÀ-ÖØ-öø-ÿ]*").fullmatch
_SPECIAL = "<|endoftext|>"

_loaded: dict[tuple, Encoder] = {}


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids exactly as the tokenizer gives them.

    For texts of common characters the same vocabulary is read as ranks, which is four times faster. All
    other texts, and those that spell the special token, go to the tokenizer itself.
    """

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(paths[0])
        with open(paths[1], "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, text: str) -> np.ndarray:
        if _SPECIAL in text or not _COMMON(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def _encoder(paths: tuple[str, str]) -> Encoder:
    if paths not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[paths] = Encoder(paths)
    return _loaded[paths]


def _pieces(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], size: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(paths)
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encoder.encode(text), np.uint32(end)).astype("<u4")
            first = len(ids) % size or min(size, len(ids))
            cuts = [0, *range(first, len(ids) + 1, size)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        doc, piece, start, length, crc = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc, pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def cut(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = END,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    paths = paths or tokenizer_paths()
    return id_and_text(docs, id_col, text_col).mapInArrow(
        lambda batches: _pieces(batches, paths, size, end),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def fullest(counts: dict[int, int], size: int) -> list[int]:
    """The longest piece left and those that, added to it, leave the least slack."""
    first = max(counts)
    room = size - first
    whole = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted(counts, reverse=True):
        have = counts[length] - (length == first)
        if length > room or have < 1:
            continue
        times, block = min(have, room // length), 1
        while times > 0:  # 1, 2, 4, ... copies at a time reach every number of copies
            block = min(block, times)
            steps.append((length, block, sums))
            sums |= (sums << (length * block)) & whole
            times -= block
            block *= 2
        if sums >> room & 1:
            break
    goal = sums.bit_length() - 1
    chosen = [first]
    for length, block, before in reversed(steps):
        if not before >> goal & 1:
            chosen += [length] * block
            goal -= length * block
    return chosen


def plan(lengths: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(combination, how many bins hold it), using up all lengths."""
    counts, bins = dict(lengths), []
    while counts:
        combination = fullest(counts, size)
        need = Counter(combination)
        times = min(counts[k] // n for k, n in need.items())
        bins.append((combination, times))
        for k, n in need.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return bins


class Places:
    """Where the piece of a given rank among its length goes."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        rows: dict[int, list[tuple]] = {}
        used: Counter = Counter()
        base = 0
        for combination, times in bins:
            offset = 0
            for length, n in Counter(combination).items():
                rows.setdefault(length, []).append((used[length], n, base, offset))
                used[length] += n * times
                offset += n * length
            base += times
        self.rows = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, n, base, offset = self.rows[length]
        at = np.searchsorted(first, ranks, "right") - 1
        inside = ranks - first[at]
        return base[at] + inside // n[at], offset[at] + inside % n[at] * length


def _placed(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            mine = lengths == length
            sequence[mine], offset[mine] = places.of(int(length), ranks[mine])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = END,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(cut(docs, id_col, text_col, size, end, paths), "pieces")
    total = pieces.count()
    groups = -(-total // GROUP) or 1
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    pieces = pieces.withColumn("group", group)
    counted = pieces.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    counted = staged(counted, "counts")
    # At most `size` rows, whatever the input.
    lengths = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(lengths, size)))
    # Groups before this one; the groups of a length are a thousandth of its pieces or fewer.
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select(
        "length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    inside = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1)
    # The shifts grow with the data, so they are merged, never broadcast; the pieces lie in order already.
    ranked = ranked.join(shifts.hint("merge"), ["length", "group"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("shift")).alias("rank")
    )
    return ranked.mapInArrow(
        lambda batches: _placed(batches, places.value),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
