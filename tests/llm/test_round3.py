"""The prefix trie, the chosen-path join and hard negatives against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import lower, sha
from vigilog.llm import chosen_path, hard_negatives, prefix_trie
from vigilog.llm.common import numbered, spread_join


def table(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# --- prefix trie ---------------------------------------------------------------------------


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, sha(text), text))
    talks = {c: [(role, text) for _, role, _, text in sorted(rows)] for c, rows in own.items()}
    built = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = talks.get(base, [])[:h] + talks[c][h:]
    members = defaultdict(list)
    for c, talk in built.items():
        for d in range(len(talk) + 1):
            members[tuple(talk[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        last = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[x] for x in children[node])
    out = []
    for node, held in members.items():
        ends = sorted(c for c in held if len(built[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(held), len(node), above, len(held), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


TURNS = "conv_id long, turn int, role string, text string"


def test_trie_of_random_conversations(make):
    rng = random.Random(5)
    turns = []
    for c in [*range(0, 260, 3), *range(100, 140), -5, -250, 10**12, 10**12 + 7]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            turns.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * 9])))
    turns += turns[:40] + [(None, 1, "user", "lost"), (None, None, None, None)]
    found = prefix_trie.conversation_trie(make(turns, TURNS))
    assert table(found) == brute_trie(turns)


def test_trie_of_one_long_conversation_and_of_copies(make, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "RUN", 8)
    turns = [(7, t, "user", f"turn {t // 2}") for t in range(70)] + [(7, 3, "user", "turn 1")] * 5
    turns += [(c, t, "user", "same") for c in range(200, 240) for t in range(3)]
    found = prefix_trie.conversation_trie(make(turns, TURNS))
    assert table(found) == brute_trie(turns)


def test_trie_of_nothing_and_of_turnless_conversations(make):
    assert prefix_trie.conversation_trie(make([], TURNS)).count() == 0
    # Conversations whose opening is borrowed from one that is not there, and that have no more turns than that.
    turns = [(c, 0, "user", "x") for c in range(901, 960) if zlib.crc32(str(c).encode()) % 6 > 0]
    found = prefix_trie.conversation_trie(make(turns, TURNS))
    assert table(found) == brute_trie(turns)
    assert found.count() == 1


# --- chosen-path join ----------------------------------------------------------------------


def brute_near(docs):
    sets = []
    for _, text in docs:
        words = lower(text).encode().split()
        sets.append({b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    parent = list(range(len(docs)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, (a, _) in enumerate(docs):
        for j in range(k):
            if a is None or docs[j][0] is None or not sets[k] or not sets[j]:
                continue
            both = len(sets[k] & sets[j])
            if 100 * both >= 80 * (len(sets[k]) + len(sets[j]) - both):
                parent[top(k)] = top(j)
    least = {}
    for k, (a, _) in enumerate(docs):
        if a is not None:
            least[top(k)] = min(least.get(top(k), a), a)
    return sorted(((a, len(sets[k]), least.get(top(k)) if a is not None else None,
                    a is None or least[top(k)] == a) for k, (a, _) in enumerate(docs)), key=str)


DOCS = "doc_id long, text string"


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 5 + str(rng.random()) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def planted():
    """A hub and its spokes, chains, and pairs on both sides of the threshold."""
    rng = random.Random(9)
    docs = []
    for size in (12, 60, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            docs.append(base)
            docs += [edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05])) for _ in range(25)]
            for _ in range(6):
                base = edited(rng, base, 0.02)
                docs.append(base)
    docs = [" ".join(d) for d in docs]
    docs += docs[:20] + [d.upper() for d in docs[20:30]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_copies_against_all_pairs(make, planted):
    assert table(chosen_path.near_duplicates(make(planted, DOCS))) == brute_near(planted)


def test_large_nodes_branch_and_go_in_blocks(make, planted, monkeypatch):
    monkeypatch.setattr(chosen_path, "PAIRS_AT_ONCE", 30)
    monkeypatch.setattr(chosen_path, "BLOCK", 5)
    monkeypatch.setattr(chosen_path, "LAST_LEVEL", 3)
    assert table(chosen_path.near_duplicates(make(planted, DOCS))) == brute_near(planted)


def test_near_copies_in_odd_tables(make, odd_docs, long_text):
    docs = [*odd_docs, (None, "one two three"), (None, None), (3, "another text under the same id"), (20, long_text + " end")]
    assert table(chosen_path.near_duplicates(make(docs, DOCS))) == brute_near(docs)
    assert chosen_path.near_duplicates(make([], DOCS)).count() == 0
    assert chosen_path.near_duplicates(make([(1, None)], DOCS)).count() == 1


# --- hard negatives ------------------------------------------------------------------------


def brute_negatives(vectors):
    rows = []
    for number, vector, label in vectors:
        if number is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(np.float64(np.float32(x)) * 256)) for x in vector]
        rows.append((number, (label + 1) % 10 if number % 7 == 0 else label, whole))
    out = []
    for a, label, x in rows:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), n, m) for n, m, y in rows if n != a]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:5]:
            held = sorted(r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s)[:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(held)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("clustered", [False, True])
def test_negatives_against_all_pairs(make, clustered, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    rng = np.random.default_rng(3)
    vectors = []
    for k in range(0, 600):
        centre = 3.0 * (k % 4) if clustered else 0.0
        vectors.append((k, [float(x) for x in rng.normal(centre, 1, 12)], int(k % 5)))
    # A vector that fills a third of the table, short, long, empty and unusable ones.
    vectors += [(1000 + k, vectors[50][1], 1 + k % 2) for k in range(200)]
    vectors += [(2001, [1.0], 0), (2002, [], 1), (2003, [1.0] * 30, 2), (2050, [float("nan")], 1), (2100, None, 1),
                (2150, [1.0, None], 1), (2200, [1.0], None), (None, [1.0], 1), (2250, [float("inf")], 1)]
    found = hard_negatives.hard_negatives(make(vectors, VECTORS))
    assert table(found) == brute_negatives(vectors)


def test_negatives_of_nothing(make):
    assert hard_negatives.hard_negatives(make([], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(make([(0, [1.0], 1)], VECTORS)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(rng.integers(0, 40, (80, 1)) * 10, 20, (80, 16))).astype(np.int64)
    means, deviations = hard_negatives._summaries(vectors)
    start = 0
    exact = vectors @ vectors.T
    for count in hard_negatives.SEGMENTS:
        here = slice(start, start + count)
        start += count
        centre = (means[:, here] * (16 // count)) @ means[:, here].T
        spread = deviations[:, here] @ deviations[:, here].T
        assert (centre - spread <= exact + 1e-6).all() and (exact <= centre + spread + 1e-6).all()


# --- helpers -------------------------------------------------------------------------------


def test_numbers_and_joins_of_hot_groups(spark):
    rows = [("hot", k % 3, k) for k in range(2000)] + [(f"g{k}", k, k) for k in range(50)] + [(None, 1, 1)]
    frame = spark.createDataFrame(rows, "g string, o int, k long").repartition(5)
    found = defaultdict(list)
    for r in numbered(frame, ["g"], ["o"]).collect():
        found[r.g].append((r.at, r.o))
    for held in found.values():
        held.sort()
        assert [a for a, _ in held] == list(range(len(held)))
        assert [o for _, o in held] == sorted(o for _, o in held)
    values = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, v int")
    joined = spread_join(frame, "g", values, "k")
    assert joined.groupBy("g", "v").count().orderBy("g").collect() == [("g1", 2, 1), ("hot", 1, 2000)]
