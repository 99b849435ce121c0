"""Archives, conversations, the pipeline and the registered oracles."""

import gzip
import io
import re

import brute
import duckdb
import pytest
from pyspark.sql import functions as F
from vigilog.llm import chat, oracle, queries, warc

PAGES = [
    (1, "http://a/1", "short"),
    (2, "http://a/2", "short"),
    (3, None, "é" * 120),
    (4, "http://a/4\r\nX: y", "é" * 120),
    (5, "u", None),
    (6, "u", ""),
    (7, "u", "WARC/1.1\r\nWARC-Type: fake\r\n\r\n" + "y" * 100 + "\r\n\r\nWARC/1.1"),
    (8, "u", "z" * 3_000_000),
    (9, "u", "z" * 3_000_000),
    (2, "http://a/2", "short"),
]


@pytest.fixture(scope="module")
def pages(make):
    return make(PAGES, "page_id long, url string, html string")


def test_archives_come_back_whole(pages):
    got = sorted(tuple(r) for r in warc.archive_report(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))
    ).collect())
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or ""))
        again = len(data) >= 100 and first != page
        want.append((page, len(data), brute.sha(data), "revisit" if again else "response", first if again else -1))
    assert got == sorted(want)


def test_predicates_reach_the_parser(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/archive"
    warc.write_warc(pages, folder)
    revisits = warc.read_warc(spark, folder, payload=False).filter("record_type = 'revisit'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan) and revisits.count() == 2
    reader = warc.WarcReader(folder, False)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 1)]))
    assert len(rest) == 1
    found = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[0] for r in found} == {"revisit"} and all(r[-1] is None for r in found)
    both = warc.read_warc(spark, folder).filter(F.col("record_type").isin("revisit", "response"))
    assert both.count() == len(PAGES)


def test_a_cut_archive_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort"
    with pytest.raises(EOFError):
        list(warc.parse(io.BytesIO(record), lambda f: True, True))
    with pytest.raises(EOFError):
        list(warc.parse(io.BytesIO(record), lambda f: False, True))
    two = gzip.compress(record[:-5].replace(b"50", b"0") + b"\r\n\r\n") * 2  # members of one file
    assert len(list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(two)), lambda f: True, True))) == 2


def test_no_pages(make):
    assert warc.archive_report(make([], "page_id long, url string, html string")).count() == 0


# --- conversations -------------------------------------------------------------------------

MARKS = "</s>[INST] ok [/INST]"
NODES = [  # tree, node, parent, role, text, score
    (1, 1, None, "system", "<<SYS>> \\ be [kind]", 0.0),
    (1, 2, 1, "user", MARKS, 1.0),
    (1, 3, 2, "assistant", "worse", 1.0),
    (1, 4, 2, "assistant", "better \n" + MARKS, 2.0),
    (1, 5, 4, "tool[x]", None, 0.0),
    (2, 1, 99, None, "lost parent", None),
    (3, 1, 2, "user", "cycle", 0.0),
    (3, 2, 1, "user", "cycle", 0.0),
    (4, 7, None, "user", "tie a", 0.0),
    (4, 8, 7, "assistant", "a", 1.0),
    (4, 9, 7, "assistant", "b", 1.0),
    (4, 9, 7, "assistant", "b", 1.0),
    (5, 1, None, "assistant", "x\\" * 40_000, 0.0),
]


@pytest.fixture(scope="module")
def formatted(make):
    table = make(NODES, "tree long, node long, parent long, role string, text string, score double")
    return {r["tree"]: r for r in chat.format_branches(table.withColumn("n", F.lit(1))).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")
    ).collect()}


def test_the_best_branch_is_formatted_and_read_back(formatted):
    one = formatted[1]
    assert [tuple(t) for t in one["turns"]] == [
        ("system", "<<SYS>> \\ be [kind]"), ("user", MARKS), ("assistant", "better \n" + MARKS), ("tool[x]", "")
    ]
    assert one["m"] == "better \n" + MARKS
    assert formatted[2]["turns"][0]["text"] == "lost parent" and 3 not in formatted
    assert [t["text"] for t in formatted[4]["turns"]] == ["tie a", "a"]
    assert formatted[5]["m"] == "x\\" * 40_000


def test_every_branch_can_be_asked_for(make):
    table = make(NODES, "tree long, node long, parent long, role string, text string, score double")
    rows = chat.format_branches(table, most=5).groupBy("tree").count().collect()
    assert dict(map(tuple, rows)) == {1: 2, 2: 1, 4: 2, 5: 1}


def test_long_threads(spark):
    rows = [(1, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", 0.0) for i in range(1, 300)]
    table = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    row = chat.format_branches(table).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in row["t"]] == [f"t{i}" for i in range(1, 300)]


def test_turns_without_a_conversation_belong_together(make):
    turns = [(None, 1, "user", "hi"), (None, 2, "assistant", "there"), (7, 1, "assistant", "alone")]
    table = make(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_branches(chat.as_tree(table, "conv_id", "turn", "role", "text"))
    report = {r["conv_id"]: r for r in chat.conversation_report(formatted).collect()}
    assert set(report) == {None, 7} and report[None]["n_turns"] == 2 and report[None]["loss_chars"] == 5
    loose = make([(1, None, None, "user", "x", 0.0)], "tree long, node long, parent long, role string, text string, score double")
    assert chat.format_branches(loose).count() == 0


def test_no_conversations(make):
    none = make([], "conv_id long, turn long, role string, text string")
    tree = chat.as_tree(none, "conv_id", "turn", "role", "text")
    assert chat.conversation_report(chat.format_branches(tree)).count() == 0


# --- all together --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(oracle.ORACLE[name])
    names = sorted(want.columns)
    expected = sorted(str(tuple(r)) for r in want.project(", ".join(names)).fetchall())
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == names
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == expected


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len({brute.lower(t) for t in texts.values()}) == len(texts)
    groups = brute.near_groups(texts)
    assert all(k == v for k, v in groups.items())
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert not any(brute.contamination(t, items)[4] for t in texts.values())
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts)
