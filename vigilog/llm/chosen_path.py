"""Near duplicates by MinHash and a chosen-path set similarity join.

Each set of word shingles has 128 minwise tokens, one per hash function. In each of ``TREES`` independent trees a
document starts at the root and, at each node, goes on to every child whose token it holds and whose hash
under that node is low: 1 / 0.8 children on average, chosen by the tokens and the path alone. So two documents that
share the share s of their tokens go on together to s / 0.8 children, which dies out below the threshold and does
not at or above it. Small nodes are compared exhaustively by sketch (the whole set if short, else a sample); larger ones
branch again, and what is still large at the last level is compared exhaustively in blocks. Every pair that passes
the sketch is confirmed on the whole sets of shingles, as texts.

On each level a node's documents are first compared with one of its main component, and confirmed links are
contracted to components. Only documents outside the main component are compared with the others, and a node of
one component is done, so a group of near copies costs what it holds, not its square.

Recall: a pair of similarity 0.8 meets in a tree's second level with probability 0.47, in its sixth with 0.27, hence
in one of 20 trees with 0.99999 and 0.998; the sketch lets it pass with 0.9998, and takes a pair below the threshold for a
sure one with 0.0001 at most, which can cost links that lead to the same component. Components need one of several links.

How it scales: equal sets are one row before anything else. Rows are (path, document), 31 a document, so a group that
holds the share s of all documents holds at most s / 31 of the rows of any path; on deeper levels, where only
large nodes are left, hot paths are joined in parts. Sketches go only to nodes that hold two components or more, texts
only to pairs that pass the sketch. Each level is a table in the shared folder.

Defined cases: a null or empty text and one without words has an empty set, n_shingles 0, and is its own component;
rows that repeat an id link by their texts; a row with a null id links with nothing and is kept, its component_id
null; an empty table gives an empty result. Texts of any length are whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import id_and_bytes, spread_join
from vigilog.llm.components import components
from vigilog.session import staged

WORDS = 4
#: Linked: PERCENT * union <= 100 * intersection.
PERCENT = 80
TOKENS = 128
TREES = 20
#: Levels that every document goes down before nodes are counted, and the last level that branches.
FIRST_LEVEL, LAST_LEVEL = 2, 10
#: A node is small when its documents outside the main component times all of them are at most so many pairs,
#: and all of them so many. What is large at the last level is compared in blocks.
PAIRS_AT_ONCE, MOST_AT_ONCE, BLOCK = 1 << 20, 1 << 14, 1024
#: Shingles of a sketch. Whole sets are compared below the threshold for chance hits, samples by deviations below it.
SAMPLE, WHOLE_MARGIN, DEVIATIONS = 160, 0.03, 3.7
#: Parts that the partners of one document are confirmed in.
SALTS = 64
#: Shingles hashed at a time.
PIECE = 4096

_seeds = np.random.default_rng(20)
_MULTIPLY = _seeds.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_PLACE = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_ROOTS = _seeds.integers(0, 1 << 63, TREES, dtype=np.uint64)
_LOW = np.uint64(int((1 << 64) * 100 / PERCENT / TOKENS))


def shingles(text: bytes) -> set[bytes]:
    """The set of a text: its shingles of four words, or all its words if fewer."""
    words = text.lower().split()
    if not words:
        return set()
    return {b" ".join(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _sketch(hashes: np.ndarray) -> bytes:
    """A sample of a set: the shingles whose hashes end in j zero bits, for the least j that leaves SAMPLE or fewer.

    Sixteen counts, of the shingles with 0, 1, 2, ... zero bits or more that are held, then 16 bits of each, those with
    more zero bits first. So the sample at any higher j is a prefix, and short texts are held whole.
    """
    low = hashes & np.uint64(0x7FFF) | np.uint64(0x8000)
    zeros = np.round(np.log2((low & (~low + np.uint64(1))).astype(np.float64))).astype(np.int64)
    order = np.argsort(-zeros, kind="stable")
    counts = np.searchsorted(-zeros[order], -np.arange(16), side="right")
    counts[counts > SAMPLE] = 0
    held = hashes[order[: counts.max(initial=0)]] >> np.uint64(40) & np.uint64(0xFFFF)
    return np.concatenate([counts, held]).astype("<u2").tobytes()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the set, a digest of it, its minwise tokens of 32 bits, and its sketch."""
    for batch in batches:
        sizes, digests, tokens, sketches = [], [], [], []
        for text in batch.column(1):
            held = shingles(text.as_py())
            hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in held), np.uint64, len(held))
            hashes.sort()
            least = np.full(TOKENS, np.iinfo(np.uint64).max)
            for start in range(0, len(hashes), PIECE):
                some = hashes[start : start + PIECE, None] * _MULTIPLY + _ADD
                np.minimum(least, some.min(0), out=least)
            sizes.append(len(held))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            tokens.append((least >> np.uint64(32)).astype("<u4").tobytes())
            sketches.append(_sketch(hashes))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()),
             *[pa.array(c, pa.binary()) for c in (digests, tokens, sketches)]],
            names=["doc_id", "mark", "n", "digest", "tokens", "sketch"],
        )


# --- the trees -----------------------------------------------------------------------------


def _named(tokens: pa.Array) -> np.ndarray:
    """A row of token names per document, which tell the hash function too."""
    values = np.frombuffer(b"".join(tokens.to_pylist()), "<u4").reshape(-1, TOKENS).astype(np.uint64)
    return _mixed(values ^ _PLACE)


def _children(names: np.ndarray, paths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths one level down, and the row of ``names`` that owns each."""
    found, owners = [], []
    for start in range(0, len(paths), PIECE):
        some, whose = paths[start : start + PIECE], owner[start : start + PIECE]
        here = _mixed(names[whose] ^ some[:, None])
        row, token = np.nonzero(here < _LOW)
        found.append(_mixed(here[row, token] + some[row]))
        owners.append(whose[row])
    return np.concatenate(found), np.concatenate(owners)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, key) of the nodes at the first level, from (key, tokens)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = _named(batch.column(1))
        paths, owner = np.tile(_ROOTS, len(names)), np.repeat(np.arange(len(names)), TREES)
        for _ in range(FIRST_LEVEL):
            paths, owner = _children(names, paths, owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths.view(np.int64)), batch.column(0).take(pa.array(owner))], names=["path", "key"]
        )


def _branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, key) one level down, from (key, tokens, paths)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, lists = _named(batch.column(1)), batch.column(2)
        owner = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
        paths, owner = _children(names, lists.flatten().to_numpy().view(np.uint64), owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths.view(np.int64)), batch.column(0).take(pa.array(owner))], names=["path", "key"]
        )


# --- comparing -----------------------------------------------------------------------------


def _judged(both: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether samples with ``both`` of ``a`` and ``b`` shingles in common can be of linked sets, and surely are.

    Whole sets are told apart but for chance hits of 16 bits, samples by 3.7 standard deviations.
    """
    union = np.maximum(a + b - both, 1)
    margin = np.where(level > 0, DEVIATIONS * np.sqrt(PERCENT * (100 - PERCENT) / 1e4 / union), WHOLE_MARGIN)
    like = both / union - PERCENT / 100
    return like >= -margin, like >= margin


class Samples:
    """The sketches of some rows, for counting what one of them shares with others."""

    def __init__(self, column: pa.Array):
        rows = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
        self.counts = np.stack([r[:16] for r in rows]).astype(np.int64)
        # The first level that is held.
        self.level = np.argmax(self.counts > 0, axis=1)
        self.held = [r[16:] for r in rows]
        self.starts = np.cumsum([0, *map(len, self.held)])
        self.values = np.concatenate(self.held)
        self.table = np.zeros(1 << 16, bool)

    def shared(self, k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each of ``others``: shingles in common with row k, those of k, its own, and the level that was used."""
        level = np.maximum(self.level[others], self.level[k])
        both = np.zeros(len(others), np.int64)
        for now in np.unique(level).tolist():
            mine = self.held[k][: self.counts[k, now]]
            at = np.nonzero(level == now)[0]
            sizes = self.counts[others[at], now]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(self.starts[others[at]] - (ends - sizes), sizes)
            self.table[mine] = True
            hits = np.cumsum(self.table[self.values[places]])
            self.table[mine] = False
            hits = np.concatenate([[0], hits])
            both[at] = hits[ends] - hits[ends - sizes]
        return both, self.counts[k, level], self.counts[others, level], level


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sketch of a, sketch of b) that may be alike."""
    for batch in batches:
        if batch.num_rows:
            n = batch.num_rows
            samples = Samples(pa.concat_arrays([batch.column(2), batch.column(3)]))
            held = [bool(_judged(*samples.shared(k, np.array([n + k])))[0][0]) for k in range(n)]
            yield batch.select(["a", "b"]).filter(pa.array(held))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first columns, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        fresh = np.zeros(batch.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(fresh)[0].tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            now = tuple(c[start] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs to confirm within each group: those that may be alike and lie in different components.

    Rows: path, left, right, side, minor, key, part, n, sketch, paths. A group has rows outside the node's main
    component on its left side, and any of the node's on its right. Sure pairs join components at once, and
    one pair is put out for each such step; of the others those that are still apart at the end. Of the nodes
    that both documents of such a pair are in (paths), only the one of least path puts it out.
    """
    for group in _groups(batches, 3):
        path = group.column(0)[0].as_py()
        side, minor, key, part, n = (group.column(k).to_numpy() for k in range(3, 8))
        samples = Samples(group.column(8))
        root = np.unique(part, return_inverse=True)[1]
        right = np.nonzero(side == 1)[0]
        out: list[tuple[int, int]] = []
        open_left, open_right = [], []
        for k in np.nonzero(side == 0)[0].tolist():
            sized = (100 * n[right] >= PERCENT * n[k]) & (PERCENT * n[right] <= 100 * n[k])
            others = right[sized & (root[right] != root[k]) & ((minor[right] == 0) | (key[right] > key[k]))]
            if not len(others):
                continue
            may, sure = _judged(*samples.shared(k, others))
            near = others[sure]
            met, first = np.unique(root[near], return_index=True)
            out.extend((k, x) for x in near[first].tolist())
            root[np.isin(root, met)] = root[k]
            maybe = others[may & ~sure]
            open_left.append(np.full(len(maybe), k))
            open_right.append(maybe)
        if open_left:
            a, b = np.concatenate(open_left), np.concatenate(open_right)
            apart = root[a] != root[b]
            lists = {k: set(group.column(9)[k].as_py()) for k in np.unique([a[apart], b[apart]]).tolist()}
            out.extend(p for p in zip(a[apart].tolist(), b[apart].tolist()) if min(lists[p[0]] & lists[p[1]]) == path)
        if out:
            a, b = key[np.array(out)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) by whole sets. Rows: a, salt, b, text, sorted; the row without b has the text of a."""
    known, held = None, set()
    for batch in batches:
        out = []
        columns = [batch.column(k).to_pylist() for k in (0, 2)]
        for k, (a, b) in enumerate(zip(*columns, strict=True)):
            mine = shingles(batch.column(3)[k].as_py())
            if b is None:
                known, held = a, mine
                continue
            if known != a:
                raise ValueError("a text to compare with is missing")
            both = len(mine & held)
            if PERCENT * (len(mine) + len(held) - both) <= 100 * both:
                out.append((a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


PAIRS = "a long, b long"


class Join:
    """The classes of equal sets, what is known of their links, and the texts that confirm them."""

    def __init__(self, classes: DataFrame, docs: DataFrame):
        self.tokens = classes.select("key", "tokens")
        self.sketches = classes.select("key", "n", "sketch")
        self.classes, self.docs = classes, docs
        self.links: list[DataFrame] = []
        self.tried: list[DataFrame] = []
        self.parts: DataFrame | None = None
        self.texts: DataFrame | None = None

    def hold_texts(self, keys: DataFrame) -> None:
        """The texts of the classes that any node shares, read once; ids may repeat, hence the mark."""
        wanted = self.classes.select("key", "head", F.col("mark").alias("wanted")).join(keys, "key", "left_semi")
        same = (F.col("doc_id") == F.col("head")) & (F.col("mark") == F.col("wanted"))
        self.texts = staged(self.docs.join(wanted, same).select("key", "text"), "texts")

    def with_parts(self, rows: DataFrame) -> DataFrame:
        if self.parts is None:
            return rows.withColumn("part", F.col("key"))
        known = self.parts.withColumnsRenamed({"node": "key", "component": "part"})
        return rows.join(known, "key", "left").withColumn("part", F.coalesce("part", "key"))

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the links among ``pairs``, of those not yet tried, and contracts them."""
        pairs = reduce(lambda left, known: left.join(known, ["a", "b"], "left_anti"), self.tried, pairs.distinct())
        pairs = staged(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), "pairs")
        self.tried.append(pairs.select("a", "b"))
        heads = pairs.select("a", "salt").distinct().join(self.texts.withColumnRenamed("key", "a"), "a")
        others = pairs.join(self.texts.withColumnRenamed("key", "b"), "b")
        rows = heads.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").unionByName(
            others.select("a", "salt", "b", "text")
        )
        dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        links = staged(dealt.mapInArrow(_confirmed, PAIRS), "links")
        if not links.isEmpty():
            self.links.append(links)
            self.parts = staged(components(reduce(DataFrame.unionByName, self.links)), "parts")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches let them pass."""
        sketch = self.sketches.select(F.col("key").alias("b"), "n", F.col("sketch").alias("sb"))
        other = self.sketches.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        sized = (100 * F.col("na") >= PERCENT * F.col("n")) & (PERCENT * F.col("na") <= 100 * F.col("n"))
        both = spread_join(pairs.distinct(), "a", other, "b").join(sketch, "b").filter(sized)
        return both.select("a", "b", "sa", "sb").mapInArrow(_passing, PAIRS)


def _with_node(rows: DataFrame, spread: bool) -> DataFrame:
    """(path, key, part) with their node: its size, its main component, who is outside that, a document to compare with.

    Only nodes of two components or more.
    """
    each = rows.groupBy("path", "part").agg(F.count(F.lit(1)).alias("held"), F.min("key").alias("least"))
    nodes = each.groupBy("path").agg(
        F.sum("held").alias("size"), F.max(F.struct("held", "part", "least")).alias("main"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select(
        "path", "size", F.col("main.part").alias("main"), F.col("main.least").alias("least"),
        (F.col("size") - F.col("main.held")).alias("outside"),
    )
    return spread_join(rows, "path", nodes, "key") if spread else rows.join(nodes, "path")


def _is_small() -> Column:
    return (F.col("outside") * F.col("size") <= PAIRS_AT_ONCE) & (F.col("size") <= MOST_AT_ONCE)


def _exhaustive(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidate pairs of the nodes of ``rows``: all outside the main component with all. Large nodes go in blocks."""
    long = "long"
    lefts = F.when(_is_small(), 1).otherwise(F.ceil(F.col("outside") / BLOCK)).cast(long)
    rights = F.when(_is_small(), 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast(long)
    minor = (F.col("part") != F.col("main")).cast("int")
    entry = F.struct("path", minor.alias("minor"), lefts.alias("lefts"), rights.alias("rights"))
    # A document has few paths: their number does not grow with the table.
    each = rows.groupBy("key", "part").agg(F.collect_list(entry).alias("entries")).join(sketches, "key")
    each = each.select(
        "key", "part", "n", "sketch", F.transform("entries", lambda e: e["path"]).alias("paths"),
        F.explode("entries").alias("e"),
    ).select("e.*", "key", "part", "n", "sketch", "paths")
    zero, mark = F.lit(0).cast(long), F.xxhash64("key", F.lit(1))
    on_left = F.transform(
        F.sequence(zero, F.col("rights") - 1),
        lambda k: F.struct(F.pmod(mark, "lefts").alias("left"), k.alias("right"), F.lit(0).alias("side")),
    )
    on_right = F.transform(
        F.sequence(zero, F.col("lefts") - 1),
        lambda k: F.struct(k.alias("left"), F.pmod(mark, "rights").alias("right"), F.lit(1).alias("side")),
    )
    places = F.when(F.col("minor") == 1, F.concat(on_left, on_right)).otherwise(on_right)
    dealt = each.withColumn("place", F.explode(places)).select(
        "path", "place.left", "place.right", "place.side", "minor", "key", "part", "n", "sketch", "paths"
    )
    dealt = dealt.repartition("path", "left", "right").sortWithinPartitions("path", "left", "right")
    return dealt.mapInArrow(_compared, PAIRS)


def _pivots(rows: DataFrame) -> DataFrame:
    """Each document outside the main component with one inside."""
    return rows.filter("part <> main").select(F.col("least").alias("a"), F.col("key").alias("b"))


def _joined(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, component) of the classes that have links; None where none has."""
    join = Join(classes, docs)
    rows = staged(join.tokens.mapInArrow(_planted, "path long, key long"), "paths")
    rows = staged(_with_node(join.with_parts(rows), False), "level")
    join.hold_texts(rows.select("key").distinct())
    join.confirm(join.alike(_pivots(rows)))
    level = FIRST_LEVEL
    while True:
        rows = staged(_with_node(join.with_parts(rows.select("path", "key")), True), "level")
        at_once = _is_small() if level < LAST_LEVEL else F.lit(True)
        pairs = _exhaustive(rows.filter(at_once), join.sketches)
        large = rows.filter(~at_once)
        go_on = not large.isEmpty()
        if go_on:
            # A document has few paths: their number does not grow with the table.
            lists = large.groupBy("key").agg(F.collect_list("path").alias("paths"))
            down = join.tokens.join(lists, "key").select("key", "tokens", "paths")
            below = staged(down.mapInArrow(_branched, "path long, key long"), "paths")
            rows = staged(_with_node(join.with_parts(below), True), "level")
            pairs = pairs.unionByName(join.alike(_pivots(rows)))
            level += 1
        join.confirm(pairs)
        if not go_on:
            return join.parts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    read = id_and_bytes(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    sets = "doc_id long, mark long, n long, digest binary, tokens binary, sketch binary"
    described = staged(read.mapInArrow(_described, sets), "described")
    full = described.filter("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "mark"))
    heads = full.groupBy("digest").agg(
        first.alias("h"), F.any_value("tokens").alias("tokens"),
        F.any_value("sketch").alias("sketch"), F.max("n").alias("n"),
    )
    heads = heads.select("digest", F.col("h.doc_id").alias("head"), F.col("h.mark").alias("mark"), "tokens", "n", "sketch")
    # Written once, so that the numbers stay.
    classes = staged(heads.withColumn("key", F.monotonically_increasing_id()), "classes")
    parts = _joined(classes, read)
    named = classes.select("digest", "key", "head")
    if parts is not None:
        least = named.join(parts.withColumnRenamed("node", "key"), "key")
        least = staged(least.select("key", "head", "component"), "members")
        answers = least.groupBy("component").agg(F.min("head").alias("found"))
        answers = spread_join(least, "component", answers, "key").select("key", "found")
        named = named.join(answers, "key", "left").withColumn("head", F.coalesce("found", "head"))
    named = staged(named.select("digest", F.col("head").alias("component_id")), "answers")
    rows = described.select("doc_id", "n", "digest")
    linked = spread_join(rows.filter("n > 0 and doc_id is not null"), "digest", named, "doc_id")
    alone = rows.filter("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
