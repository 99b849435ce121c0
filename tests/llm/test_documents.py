"""The operators over documents, against plain versions, on odd tables."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from vigilog.llm import (
    chaining,
    common,
    components,
    decontaminate,
    exact_dedup,
    packing,
    pii,
    quality,
    simhash,
    suffix_dedup,
)

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(make, odd_docs):
    return make(odd_docs, SCHEMA)


@pytest.fixture(scope="module")
def empty(make):
    return make([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_columns_are_as_given(docs, odd_docs):
    assert docs.count() == len(odd_docs) and len(docs.columns) > 10


# --- personal data -------------------------------------------------------------------------


def test_base_spans_match_the_plain_rules(make, docs, odd_docs):
    tricky = [
        (100, "a@b.c_d@e.f x@y.z.w, @no.user a@b 1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1234"),
        (101, "4111-1111-1111-1111 4111 1111 1111 1112 12 34 +1 23 +12345678 +1 (2) 345.678-90(1 +123456789012345678"),
        (102, "ü@ü.de ää 10.0.0.1é 😀 a.b-c%d+e@f-g.h-i +49 30 123456 7"),
        (103, "a@b." + "c." * 20_000 + "d"),
        (104, "1." * 30_000),
        (105, "a" * 60_000 + "@"),
    ]
    table = docs.unionByName(make(tricky, SCHEMA))
    got = by_id(pii.find_personal_data(table))
    for doc, text in [*odd_docs, *tricky]:
        want = brute.personal(text)
        assert got[doc]["base_sha256"] == brute.sha(want), doc
        assert got[doc]["spans"] == want, doc
        for kind in pii.KINDS:
            assert got[doc][f"n_{kind}"] == sum(s.startswith(kind) for s in want.split(","))


def test_a_confident_pattern_finds_what_the_rules_miss(make):
    rows = [(i, f"the lamp and Phone: +1 555 010 {1000 + i} is here") for i in range(20)]
    rows += [(20, "we say Phone: 555-0199-77 today"), (21, "the 555-0199-78 today"), (22, "Phone: soon")]
    got = by_id(pii.find_personal_data(make(rows, SCHEMA)))
    assert got[20]["spans"] == "phone:14:25" and got[20]["n_phone"] == 0
    assert got[21]["spans"] == "" and got[22]["spans"] == ""


def test_discovered_instances_induce_patterns(make):
    """No base seed stands beside 'Mobil:', only numbers that were found beside 'Phone:'."""
    rows = [(i, f"lamp{i} Phone: +1 555 010 {1000 + i} here{i}") for i in range(20)]
    rows += [(100 + i, f"say{i} Phone: 555-0199-7{i} day{i}") for i in range(4)]
    rows += [(200 + i, f"ring{i} Mobil: 555-0199-7{i % 4} now{i}") for i in range(40)]
    rows += [(300, "also Mobil: 555-0777-99 soon"), (301, "the 555-0777-98 soon")]
    got = by_id(pii.find_personal_data(make(rows, SCHEMA)))
    assert got[100]["spans"] and got[200]["spans"]
    assert got[300]["spans"] == "phone:12:23" and got[301]["spans"] == ""


def test_rounds_go_on_until_the_scores_settle(make):
    """One seed in five of the word's uses: trust comes up slowly, but it does come up to the threshold."""
    rows = [(i, f"lamp{i} Phone: +1 555 010 {1000 + i} here{i}") for i in range(20)]
    rows += [(100 + i, f"say{i} Phone: 555-01{i:02d}-7{i % 9} day{i}") for i in range(80)]
    got = by_id(pii.find_personal_data(make(rows, SCHEMA)))
    assert sum(got[100 + i]["spans"] != "" for i in range(80)) == 80


def test_scores_are_those_of_a_plain_bootstrap(spark):
    rng = random.Random(5)
    words = [f"w{i}:" for i in range(12)]
    edges = [
        (rng.choice(words), f"n{rng.randint(0, 60)}", rng.random() < 0.3) for _ in range(400)
    ]
    spent = Counter(w for w, _, _ in edges)
    total = {w: n + (i % 4) * n // 3 for i, (w, n) in enumerate(sorted(spent.items()))}
    sides = {True: [], False: []}
    for word, value, trusted in edges:
        sides[trusted].append(("phone", value, word, ""))
    schema = "kind string, value string, left string, right string"
    got = pii.score_patterns(
        spark.createDataFrame(sides[True], schema), spark.createDataFrame(sides[False], schema),
        spark.createDataFrame(list(total.items()), "word string, n long"),
    )
    assert {r["word"] for r in got.collect()} == brute.bootstrap(edges, total, pii.CONFIDENT, pii.SUPPORT)


def test_personal_data_of_nothing(empty):
    assert pii.find_personal_data(empty).count() == 0


# --- decontamination -----------------------------------------------------------------------

ITEMS = {
    1: " ".join(f"w{i % 977}x{i}" for i in range(500, 520)),
    2: "One, TWO three!",
    3: "",
    4: " ".join(f"passage{i * i}" for i in range(20, 40)),
    5: " ".join(f"passage{i * i}" for i in range(25, 45)),
    6: None,
}


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_contamination(make, docs, odd_docs, block_bytes):
    tests = make(list(ITEMS.items()), "item_id long, text string")
    report = decontaminate.contamination_report(docs, tests, block_bytes=block_bytes)
    got = by_id(report)
    assert report.count() == len(odd_docs)
    for doc, text in odd_docs:
        assert tuple(got[doc])[1:] == brute.contamination(text, ITEMS), doc


def test_pieces_of_a_long_text_overlap(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 40)
    text = " ".join(f"w{i % 7}" for i in range(300))
    windows = decontaminate.Windows([(1, b"w3 w4 w5 w6 w0"), (2, b"w1 w2")], 13)
    n, runs, items = decontaminate._scan_one(text.encode(), windows, 13)
    want = brute.contamination(text, {1: "w3 w4 w5 w6 w0", 2: "w1 w2"})
    assert (n, sum(b - a for a, b in runs), len(items)) == want[:3]


def test_hits_are_confirmed_where_hashes_collide(monkeypatch):
    class Weak(decontaminate.RangeHash):
        def of(self, starts, ends):
            return super().of(starts, ends) & np.uint64(3)

    monkeypatch.setattr(decontaminate, "RangeHash", Weak)
    items = {k: " ".join(f"w{(i * k) % 11}" for i in range(18)) for k in range(1, 6)}
    windows = decontaminate.Windows([(k, t.encode()) for k, t in items.items()], 13)
    texts = [f"z{k} {t} y" for k, t in items.items()] + [" ".join(f"v{i}" for i in range(40)), "", "w1 w2"]
    for (n, runs, found), text in zip(
        decontaminate._scan_many([t.encode() for t in texts], windows, 13), texts, strict=True
    ):
        assert (n, sum(b - a for a, b in runs), len(found)) == brute.contamination(text, items)[:3]


def test_a_block_is_as_small_as_stated():
    rng = random.Random(3)
    items = [(k, " ".join("w" * rng.randint(3, 7) + str(rng.randint(0, 9)) for _ in range(400)).encode())
             for k in range(500)]
    windows = decontaminate.Windows(items, 13)
    n_words = sum(t.count(b" ") + 1 for _, t in items)
    assert windows.nbytes <= sum(len(t) for _, t in items) + 24 * n_words + 8 * len(items) + 64


@pytest.mark.parametrize("block_bytes", [1 << 20, 32])
def test_items_without_an_id_hit_but_are_not_listed(make, block_bytes):
    docs = make([(1, "one two three"), (2, "four five"), (3, "six")], SCHEMA)
    tests = make([(None, "one two three"), (7, "four five"), (None, "four five")], "item_id long, text string")
    got = by_id(decontaminate.contamination_report(docs, tests, block_bytes=block_bytes))
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [
        (3, 0, True), (2, 1, True), (0, 0, False),
    ]


def test_spans_are_cut(make):
    docs = make([(1, "Keep this: one, two THREE. And that."), (2, None)], SCHEMA)
    cut = decontaminate.cut_spans(docs, make([(2, "One, TWO three!")], "item_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Keep this: . And that.", 2: None}


def test_no_items_no_documents(make, docs, odd_docs, empty):
    none = make([], "item_id long, text string")
    report = decontaminate.contamination_report(docs, none)
    assert report.filter("contaminated or n_hit > 0").count() == 0 and report.count() == len(odd_docs)
    assert decontaminate.contamination_report(empty, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).columns == docs.columns


# --- exact dedup ---------------------------------------------------------------------------


@pytest.mark.parametrize("capacity,depth,bits", [(4096, 20, 64), (2, 6, 64), (1, 3, 64), (2, 6, 2), (1, 3, 1)])
def test_exact_groups(docs, odd_docs, capacity, depth, bits):
    rows = exact_dedup.exact_groups(docs, capacity=capacity, max_depth=depth, key_bits=bits).collect()
    assert len(rows) == len(odd_docs)
    texts = dict(odd_docs)
    for r in rows:
        same = [d for d, t in odd_docs if brute.lower(t) == brute.lower(texts[r["doc_id"]])]
        want = (max(same), len(same), r["doc_id"] == max(same), brute.sha(brute.lower(texts[r["doc_id"]])))
        assert tuple(r)[1:] == want, r


def test_buckets_split_until_they_fit(make):
    index = exact_dedup.build_index(make([(i, f"text {i}") for i in range(300)], SCHEMA), capacity=8)
    loads = {r["bucket"]: r["count"] for r in index.entries.groupBy("bucket").count().collect()}
    assert sum(loads.values()) == 300 and max(loads.values()) <= 8
    assert index.directory.groupBy("bucket").agg({"depth": "max"}).count() >= 300 / 8


def test_colliding_texts_are_chained(make):
    docs = make([(i, f"text {i % 40}") for i in range(200)], SCHEMA)
    index = exact_dedup.build_index(docs, key_bits=3)
    links = index.entries.collect()
    assert len(links) == 40 and {r["group_size"] for r in links} == {5}
    chains = {}
    for r in links:
        chains.setdefault((r["bucket"], r["key"]), []).append(r["chain"])
    assert len(chains) <= 8 and all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())


def test_exact_dedup_with_clashing_ids(make):
    docs = make([(1, "a"), (1, "b"), (2, "A"), (2, "c"), (2, "c")], SCHEMA)
    groups = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"])
              for r in exact_dedup.exact_groups(docs).collect()}
    a, b, c = (brute.sha(t) for t in "abc")
    assert groups == {(1, a): (2, 2, False), (2, a): (2, 2, True), (1, b): (1, 1, True), (2, c): (2, 2, True)}
    stays = exact_dedup.drop_exact_duplicates(docs).collect()
    assert sorted(tuple(r)[:2] for r in stays) == [(1, "b"), (2, "A"), (2, "c"), (2, "c")]


def test_exact_dedup_of_nothing_and_null_ids(make, docs, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    got = exact_dedup.exact_groups(make([(None, "a"), (None, "b"), (1, "b")], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in got) == [
        ("1", "1", True), ("None", "1", False), ("None", "None", True),
    ]
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


# --- near dedup ----------------------------------------------------------------------------


def test_fingerprints(docs, odd_docs):
    for r in simhash.near_duplicates(docs).collect():
        assert r["fingerprint"] == f"{brute.simhash(dict(odd_docs)[r['doc_id']]):016x}"


def test_near_groups(make):
    rng, texts = random.Random(5), {}
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(400)] for _ in range(4)]
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words) if i % 9 else rng.choice([None, "", "a b", "A b"])
    got = simhash.near_duplicates(make(list(texts.items()), SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.near_groups(texts)


def test_pieces_do_not_change_a_fingerprint(monkeypatch, long_text):
    want = simhash.fingerprint(long_text[:200_000].encode())
    monkeypatch.setattr(simhash, "PIECE", 777)
    assert simhash.fingerprint(long_text[:200_000].encode()) == want


def test_near_dedup_of_nothing(docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(map(tuple, got)) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- substring dedup -----------------------------------------------------------------------


@pytest.mark.parametrize("group", [20_000, 1])
def test_removed_bytes(make, group):
    rng = random.Random(3)
    base = "".join(rng.choice("abc ") for _ in range(600))
    rows = []
    for i in range(40):
        a = rng.randrange(500)
        rows.append((i, "".join(rng.choice("abcdé") for _ in range(rng.randrange(80))) + base[a : a + rng.randrange(100)]))
    rows += [(50, None), (51, ""), (52, "z" * 200), (53, rows[0][1]), (53, rows[0][1])]
    got = suffix_dedup.removal_report(make(rows, SCHEMA), length=40, gram=8, group=group).collect()
    want = []
    data = [(t or "").encode() for _, t in rows]
    for (doc, _), t, gone in zip(rows, data, brute.removed(data, 40), strict=True):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want.append((doc, len(t), sum(gone), spans, brute.sha(kept)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_substring_dedup_of_odd_tables(docs, odd_docs, empty):
    assert suffix_dedup.removal_report(docs).count() == len(odd_docs)
    assert suffix_dedup.removal_report(empty).count() == 0


def test_multikey_sort():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 24), dtype=np.uint8)
    rows[50:90] = rows[10]
    order, shared = suffix_dedup.multikey_sort(rows)
    listed = [bytes(rows[i]) for i in order]
    assert listed == sorted(map(bytes, rows))
    for i in range(1, 300):
        same = next((k for k in range(24) if listed[i][k] != listed[i - 1][k]), 24)
        assert shared[i] == same


# --- quality -------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = common.table(spark, sf, "labels")
    scored = quality.quality_scores(common.table(spark, sf, "documents"), labels)
    rows = scored.join(labels, "doc_id").collect()
    for r in rows[:50]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.98


def test_quality_against_a_plain_discriminant(make):
    rng = random.Random(9)
    words = {0: ["BUY", "now!!!", "$$$", "9", "click"], 1: ["the", "longer", "sentence", "reads", "well.", "Evenly,"]}
    rows, labels = [], {}
    for i in range(400):
        labels[i] = int(rng.random() < 0.6)
        pick = words[labels[i]] * 3 + words[1 - labels[i]]
        rows.append((i, " ".join(rng.choice(pick) for _ in range(rng.randint(1, 60))) or None))
    rows += [(1000, None), (1001, ""), (1002, "word " * 5000)]
    scored = quality.quality_scores(make(rows, SCHEMA), make(list(labels.items()), "doc_id long, quality int")).collect()

    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in rows}
    learned = {k: np.array([x[i] for i in labels if labels[i] == k and zlib.crc32(str(i).encode()) % 5]) for k in (0, 1)}
    both = np.concatenate([learned[0], learned[1]])
    centre, scale = both.mean(0), np.sqrt(np.maximum(both.var(0), 1e-12))
    z = {k: (v - centre) / scale for k, v in learned.items()}
    within = {k: np.cov(v, rowvar=False, bias=True) for k, v in z.items()}
    n = {k: len(v) for k, v in z.items()}
    pooled = (n[0] * within[0] + n[1] * within[1]) / len(both)

    def density(k, v):
        cov = (1 - quality.TO_POOLED) * within[k] + quality.TO_POOLED * pooled
        cov = (1 - quality.TO_SPHERE) * cov + quality.TO_SPHERE * np.trace(cov) / len(cov) * np.eye(len(cov))
        cov += 1e-9 * np.eye(len(cov))
        away = v - z[k].mean(0)
        return -0.5 * (np.linalg.slogdet(cov)[1] + away @ np.linalg.solve(cov, away))

    assert len(scored) == len(rows)
    for r in scored:
        v = (x[r["doc_id"]] - centre) / scale
        odds = np.log((n[1] + 1) / (n[0] + 1)) + density(1, v) - density(0, v)
        want = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        assert r["score"] == pytest.approx(want, rel=1e-3, abs=1e-6), r
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_of_odd_tables(make, docs, odd_docs, empty):
    labels = make([(3, 1), (4, 0), (5, None), (6, 7), (3, 0), (None, 1)], "doc_id long, quality int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == len(odd_docs) and all(0 <= r["score"] <= 1 for r in scored)
    none = make([], "doc_id long, quality int")
    assert quality.quality_scores(docs, none).count() == len(odd_docs)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.drop_low_quality(docs, labels).columns == docs.columns


# --- packing -------------------------------------------------------------------------------


def test_packing_is_gapless_and_whole(docs, odd_docs):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    rows = packing.pack(docs).collect()
    sequences, total = {}, 0
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert len(sequences) <= -(-total // packing.SIZE) + 1
    texts = dict(odd_docs)
    for doc in (1, 6, 10, 13):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc)
        first = len(ids) % packing.SIZE or min(len(ids), packing.SIZE)
        cuts = [0, *range(first, len(ids) + 1, packing.SIZE)]
        assert mine == [
            (k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]


def test_ids_are_the_tokenizers():
    encoder = packing._encoder(packing.tokenizer_paths())
    for text in ["", "a b", "x<|endoftext|>y", "日本 12\n\n  z", "It's we'LL  10%\t\r\n", "Ünïcödé × ÷ ñ", "a b\u0085c"]:
        want = encoder.exact.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want, text


def test_bins_are_as_full_as_can_be():
    assert sorted(packing.fullest({7: 1, 5: 1, 4: 1, 3: 2}, 12)) == [5, 7]
    assert sorted(packing.fullest({6: 3, 4: 1, 1: 1}, 10)) == [4, 6]
    used = {}
    for combination, times in packing.plan({7: 3, 5: 2, 4: 1, 3: 2, 1: 9}, 12):
        assert sum(combination) <= 12
        for k in combination:
            used[k] = used.get(k, 0) + times
    assert used == {7: 3, 5: 2, 4: 1, 3: 2, 1: 9}


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


# --- fuzzy passages ------------------------------------------------------------------------


def _exact_repeats(texts):
    """Words in runs of 50 that another text has, too."""
    seen = {}
    for doc, w in texts.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(doc)
    out = {doc: set() for doc in texts}
    for doc, w in texts.items():
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                out[doc].update(range(i, i + 50))
    return out


def _covered(spans):
    return {k for s in filter(None, spans.split(",")) for k in range(*map(int, s.split(":")))}


def test_passages_with_edits_are_found(make):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    rows, edited = [], {}
    for i in range(30):
        own = [rng.choice(vocabulary) for _ in range(150)]
        if i % 3 == 0:
            copy = list(passage)
            for k in (30, 60):
                copy[k + i % 5] = f"edit{i}"
            if i % 6 == 0:
                del copy[45]
            edited[i] = range(70, 70 + len(copy))
            own[70:70] = copy
        rows.append((i, " ".join(own)))
    got = by_id(chaining.passage_report(make(rows, SCHEMA)))
    for i in range(30):
        found = _covered(got[i]["spans"])
        if i in edited:
            assert len(found & set(edited[i])) >= 0.95 * len(edited[i])
            assert len(found - set(edited[i])) <= 6 and got[i]["n_links"] > 0
        else:
            assert not found and got[i]["partner_id"] is None


def test_passages_of_everyday_phrases_are_found(make):
    """Every short phrase of the passage stands in many other texts, which would be its hubs."""
    passage = [f"word{k}" for k in range(60)]
    rows = [(0, " ".join(["left", *passage])), (1, " ".join([*passage, "right"]))]
    for copy in range(40):
        for k in range(0, 60, 10):
            part = passage[k : k + 20]
            rows.append((len(rows), " ".join([f"a{copy}x{k}", *part, f"b{copy}x{k}"])))
    found = {r["doc_id"]: r["spans"] for r in chaining.passage_report(make(rows, SCHEMA)).collect()}
    assert (found[0], found[1]) == ("1:61", "0:60")
    assert not any(found[k] for k in range(2, len(rows)))


@pytest.mark.parametrize("every", [7, 8])
def test_passages_with_close_edits_are_found(make, every):
    """Pairs of texts that share 60 words with one word in ``every`` replaced."""
    rng = random.Random(every)
    rows = []
    for i in range(0, 40, 2):
        passage = [f"p{i}x{k}" for k in range(60)]
        edited = [f"edit{i}x{k}" if k % every == every - 1 else w for k, w in enumerate(passage)]
        for doc, words in ((i, passage), (i + 1, edited)):
            own = [f"own{doc}x{rng.random()}".replace(".", "") for _ in range(40)]
            rows.append((doc, " ".join([*own, *words, *own[::-1]])))
    got = by_id(chaining.passage_report(make(rows, SCHEMA)))
    for doc in range(40):
        assert len(_covered(got[doc]["spans"]) & set(range(40, 100))) >= 55, doc
        assert got[doc]["partner_id"] == doc ^ 1


def test_all_texts_of_a_group_are_linked(make):
    passage = [f"word{k}" for k in range(60)]
    rows = [(i, " ".join([f"a{i}", *passage, f"b{i}"])) for i in range(7)]
    got = by_id(chaining.passage_report(make(rows, SCHEMA)))
    assert [got[i]["n_links"] for i in range(7)] == [6] * 7
    assert [got[i]["partner_id"] for i in range(7)] == [1, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("copies", [6, 40])
def test_edited_passages_of_everyday_phrases_are_found(make, copies):
    """Twelve words of the passage at a time stand in many other texts; every twentieth is replaced."""
    passage = [f"word{k}" for k in range(80)]
    edited = [f"edit{k}" if k % 20 == 19 else w for k, w in enumerate(passage)]
    rows = [(0, " ".join(["left", *passage])), (1, " ".join([*edited, "right"]))]
    for copy in range(copies):
        for k in range(0, 80, 8):
            own = [f"own{copy}x{k}x{i}" for i in range(60)]
            rows.append((len(rows), " ".join([*own, *passage[k : k + 12], *own[::-1]])))
    got = by_id(chaining.passage_report(make(rows, SCHEMA)))
    assert len(_covered(got[0]["spans"])) >= 79 and len(_covered(got[1]["spans"])) >= 79
    assert not any(got[k]["spans"] for k in range(2, len(rows)))


def test_passages_of_which_every_run_is_frequent_are_found(make):
    """Whole runs between the edits stand in many other texts, which hold no passage and are the hubs of their seeds."""
    passage = [f"word{k}" for k in range(80)]
    edited = [f"edit{k}" if k % 10 == 9 else w for k, w in enumerate(passage)]
    rows = [(0, " ".join(["left", *passage])), (1, " ".join([*edited, "right"]))]
    for copy in range(30):
        for k in range(0, 80, 10):
            own = [f"own{copy}x{k}x{i}" for i in range(60)]
            rows.append((len(rows), " ".join([*own, *passage[k : k + 10], *own[::-1]])))
    got = by_id(chaining.passage_report(make(rows, SCHEMA)))
    assert len(_covered(got[0]["spans"])) >= 79 and len(_covered(got[1]["spans"])) >= 79
    assert [got[k]["partner_id"] for k in (0, 1)] == [1, 0]
    assert all(not got[k]["spans"] and got[k]["n_links"] == 0 for k in range(2, len(rows)))


def test_exact_repeats_are_covered(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: brute.words(r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = by_id(chaining.passage_report(docs))
    for doc, repeated in _exact_repeats(texts).items():
        assert not repeated - _covered(got[doc]["spans"])
        assert got[doc]["n_words"] == len(texts[doc])


def test_chains_keep_both_orders():
    x, y = [0, 5, 10, 15, 30], [100, 105, 3, 115, 130]
    best = chaining.chains(x, y)
    assert best[0] == [0, 1, 3, 4] and sorted(sum(best, [])) == [0, 1, 2, 3, 4]


def test_passages_of_odd_tables(docs, odd_docs, empty):
    got = chaining.passage_report(docs)
    assert got.count() == len(odd_docs)
    assert {r["doc_id"] for r in got.filter("n_fuzzy > 0").collect()} >= {9, 10, 11, 12}
    assert chaining.passage_report(empty).count() == 0
