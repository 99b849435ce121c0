"""Disk: staged tables leave no shuffle files behind; the lists of alert texts are shuffled as packs of bytes."""

import random
import time

from pyspark.sql import functions as F

from vigilog.operators import alerts, profiles
from vigilog.operators import profilers as P
from vigilog.session import SHUFFLE_CLEANUP, staged, staged_in_turn


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(k).name() for k in range(blocks.size()) if blocks.apply(k).isShuffle()}


def _grouped(spark, n):
    return spark.range(n).selectExpr("xxhash64(id) AS h").groupBy("h").count()


def test_staged_tables_leave_no_shuffle_files(spark):
    held, before = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, "false")
    table = staged(_grouped(spark, 50_000), "test")
    until = time.time() + 20  # the files go in the background
    while _shuffle_files(spark) - held and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - held
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before
    assert table.count() == 50_000


def test_tables_staged_in_turn_hold_all_parts(spark):
    table = staged_in_turn([_grouped(spark, n) for n in (10, 0, 30)], "test")
    assert table.count() == 40


SEEN = "profiler string, kind string, batch_id long, value string"


def test_packs_hold_the_lists(spark, monkeypatch):
    """Of many chunks, parts and blocks, with a null, an empty and a long value, against the lists themselves."""
    monkeypatch.setattr(alerts, "BLOCK", 8)
    monkeypatch.setattr(alerts, "CHUNK", 16)
    rng = random.Random(1)
    pool = [None, "", "ä\U0001f600" * 400, *(f"10.{i}.7.{i * i}" for i in range(150))]
    rows = {(p, P.DEVIATION, b, v) for p in "xy" for b in range(40) for v in rng.sample(pool, 4)}
    seen = spark.createDataFrame(sorted(rows, key=str), SEEN)
    found, profile = profiles.deviations(seen), profiles.first_seen(seen)
    split = found.selectExpr("profiler", "batch_id", "1 + n_profile div 20 AS parts", "floor(batch_id / 8) AS block", "n_profile")
    want = {
        (r.profiler, r.parts, r.block, r.part): [(t.encode(), f) for t, f in r.held]
        for r in alerts.versioned_lists(split, profile).collect()
    }
    got = {}
    for r in alerts.packed_lists(split, profile).collect():
        texts, first = alerts._unpacked(bytes(r.data))
        got.setdefault((r.profiler, r.parts, r.block, r.part), []).extend(zip(texts, first.tolist()))
    assert {k: sorted(v) for k, v in got.items()} == want and len({k[1] for k in want}) > 3
    by_part = alerts.deviation_messages(found, profiles.alert_values(seen, found), 20, profile)
    plain = profiles.alert_values(seen, found).unionByName(profiles.profile_lists(profile, found))
    assert sorted(map(tuple, by_part.collect())) == sorted(map(tuple, alerts.deviation_messages(found, plain, 20).collect()))


def test_lists_of_alert_texts_take_few_bytes(spark, capsys):
    """A value goes through the shuffle in a few bytes for each list, not as a row of its own."""
    profile = spark.range(40_000).selectExpr(
        "'ip' AS profiler", "concat(11 + id % 30, '.', id % 256, '.', id % 4, '.', 1 + id % 200, '.', id) AS value",
        "id div 20 AS first_batch",
    )
    split = spark.range(2000, 2010).selectExpr(
        "'ip' AS profiler", "id AS batch_id", "id - 1996 AS parts", "0L AS block", "40000L AS n_profile"
    )
    packs = alerts.packed_lists(split, profile)
    size, lists = packs.agg(F.sum(F.octet_length("data")), F.countDistinct("parts", "part")).first()
    assert size < 12 * 10 * 40_000 and lists == sum(range(4, 14))
    found = split.selectExpr("profiler", "batch_id", "1L AS n_new", "1L AS n_current", "n_profile", "0L AS n_intersection")
    sections = found.selectExpr("profiler", "batch_id", "'new' AS section", "'v' AS value")
    messages = alerts.deviation_messages(found, sections, 10_000, profile)
    messages.explain()
    plan = capsys.readouterr().out
    assert "transform(" not in plan and "filter(held" not in plan  # no list is joined with every alert
    assert messages.agg(F.sum(F.length("body"))).first()[0] > 10 * 40_000 * 10
