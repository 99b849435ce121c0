"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (lengths, shares of letter kinds, marks, repeated
words and lines). Both classes get a mean and a covariance, shrunk towards the pooled one and towards a
multiple of the identity. A document's score is the logistic function of the difference of the two
Gaussian log densities plus the log prior odds; the Mahalanobis distances come from the Cholesky factors, which
are computed once and sent along.

How it scales: texts are read once; what is kept of them is a short vector. The moments of all labelled
training rows, a fixed number of sums, are aggregated by Spark and are all that reaches the driver.

Defined cases: a null or empty text has a vector like any other and gets a score; labels that are null, or
neither 0 nor 1, or that contradict each other for one id, are not learned from; with no labels of one class
every score is the share of the other; an empty table gives an empty result; repeated rows are scored each.
Long texts are measured in pieces (words count as repeated within a piece). Other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import id_and_bytes
from vigilog.session import staged

THRESHOLD = 0.3
#: How far class covariances move to the pooled one, and that to a multiple of the identity.
TO_POOLED, TO_SPHERE = 0.1, 0.002
PIECE = 1 << 20
#: Average words added to every text, so that a few words do not make an extreme share.
SOME_WORDS = 20
_SPACE = re.compile(rb"[ \t-\r]")

_UPPER = string.ascii_uppercase.encode()
_LOWER = string.ascii_lowercase.encode()
_DIGIT = string.digits.encode()
_WHITE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:?"
_CALLS = b"!"
_PLAIN = b"'\"()-"
_HIGH = bytes(range(128, 256))
_ODD = bytes(set(range(128)) - set(_UPPER + _LOWER + _DIGIT + _WHITE + _STOPS + _CALLS + _PLAIN))

NAMES = (
    "word_length", "short_words", "long_words", "upper", "high", "digits", "stops", "calls",
    "odd", "distinct", "line_words", "repeated_lines", "stopped_words",
)


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``."""
    n = words = letters = short = long = distinct = stopped = lines = fresh = filled = 0
    counts = dict.fromkeys(("upper", "high", "digits", "stops", "calls", "odd"), 0)
    kinds = dict(upper=_UPPER, high=_HIGH, digits=_DIGIT, stops=_STOPS, calls=_CALLS, odd=_ODD)
    for piece in _pieces(data):
        n += len(piece)
        for name, members in kinds.items():
            counts[name] += len(piece) - len(piece.translate(None, members))
        found = piece.split()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words += len(found)
        letters += int(sizes.sum())
        short += int((sizes <= 3).sum())
        long += int((sizes >= 9).sum())
        distinct += len(set(found))
        stopped += piece.count(b". ") + piece.count(b".\n") + piece.count(b", ")
        rows = [r for r in piece.split(b"\n") if r.strip()]
        lines += len(rows)
        fresh += len(set(rows))
        filled += 1
    w, c, k = words + SOME_WORDS, n + 6 * SOME_WORDS, lines + 2
    return [
        float(np.log1p((letters + 5 * SOME_WORDS) / w)),
        float(np.sqrt((short + SOME_WORDS / 2) / w)),
        float(np.sqrt((long + SOME_WORDS / 10) / w)),
        *(float(np.sqrt(counts[name] / c)) for name in counts),
        float((distinct + SOME_WORDS) / w + 0.08 * np.log1p(words / max(filled, 1))),
        float(np.log1p(words / k)),
        float(np.sqrt((lines - fresh) / k)),
        float(np.sqrt((stopped + SOME_WORDS / 5) / w)),
    ]


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        stop = start + PIECE
        if stop < len(data):
            gap = _SPACE.search(data, stop)
            stop = gap.start() if gap else len(data)
        yield data[start:stop]
        start = stop


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        vectors = pa.array(rows, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["doc_id", "x"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) with the statistics of every row."""
    rows = id_and_bytes(docs, id_col, text_col)
    return rows.mapInArrow(_measured, "doc_id long, x array<double>")


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  #: inverse of the lower Cholesky factor of the covariance
    log_norm: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.factor.T
        return self.log_norm - 0.5 * (z * z).sum(1)


@dataclass(frozen=True)
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None  #: of label 0 and label 1
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """How likely label 1 is."""
        odds = np.full(len(x), self.log_odds)
        if self.classes:
            z = (x - self.centre) / self.scale
            odds = odds + self.classes[1].log_density(z) - self.classes[0].log_density(z)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per label: rows, sums and sums of products. A fixed number of values, whatever the input."""
    d = len(NAMES)
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        out[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), products)
    return out


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """From (label, x)."""
    found, d = _moments(rows), len(NAMES)
    n = {k: found[k][0] if k in found else 0 for k in (0, 1)}
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n.values()) < 2:
        return Discriminant(np.zeros(d), np.ones(d), None, log_odds)
    total = n[0] + n[1]
    centre = (found[0][1] + found[1][1]) / total
    variance = np.diag(found[0][2] + found[1][2]) / total - centre**2
    scale = np.sqrt(np.maximum(variance, 1e-12))
    means, within = {}, {}
    for k in (0, 1):
        mean = found[k][1] / n[k]
        cov = found[k][2] / n[k] - np.outer(mean, mean)
        means[k], within[k] = (mean - centre) / scale, cov / np.outer(scale, scale)
    pooled = (n[0] * within[0] + n[1] * within[1]) / total
    classes = []
    for k in (0, 1):
        cov = (1 - to_pooled) * within[k] + to_pooled * pooled
        cov = (1 - to_sphere) * cov + to_sphere * np.trace(cov) / d * np.eye(d)
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        log_norm = -float(np.log(np.diag(lower)).sum())
        classes.append(Gaussian(means[k], np.linalg.inv(lower), log_norm))
    return Discriminant(centre, scale, (classes[0], classes[1]), log_odds)


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x) of the labelled rows that are not held out."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    clean = clean.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    clean = clean.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    clean = clean.filter("label = other").drop("other")
    return measured.join(clean, "doc_id").select("label", "x")


def _scored(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        score = model.score(flat.reshape(-1, len(NAMES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    measured = staged(measure(docs, id_col, text_col), "statistics")
    model = fit(training_rows(measured, labels))
    scored = measured.mapInArrow(lambda batches: _scored(batches, model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    low = quality_scores(docs, labels, id_col, text_col).filter("predicted = 0")
    low = low.select(F.col("doc_id").alias("__low"))
    return docs.join(low, docs[id_col].cast("long").eqNullSafe(low["__low"]), "left_anti")
