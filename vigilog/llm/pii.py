"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers. These are the seeds. The words right
before and right after a seed are its lexical patterns. A second, loose rule finds tokens that merely look
like an identifier of a kind (a number without its prefix, an address without a top domain). Patterns and
instances form a graph that is scored in rounds: a pattern is as good as the share of its word's
occurrences in the whole corpus that stand beside trusted instances, an instance as good as its best
pattern. A pattern counts once enough different trusted instances stand beside it: seeds, or tokens that
confident patterns discovered, so these bring in patterns of their own, round after round until no score rises.
Tokens beside patterns of high confidence and wide enough support are added as spans.

How it scales: texts are scanned, never shuffled; what leaves the scan are the matches with the word on
either side. Corpus word counts are combined on the map side. Patterns that could not reach the threshold
even if all their instances were trusted are dropped before the rounds, so everyday words, however
frequent, never enter the graph.

Defined cases: a null text is empty; matches that fail their check are dropped without a retry; a document
without findings has zero counts, the digest of the empty string, and no spans; rows are reported each, equal or
not; an empty table gives an empty result. Matching is linear in the length of a text: runs are
matched possessively and only from where they begin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import id_and_text
from vigilog.session import staged

KINDS = ("email", "ip", "card", "phone")

# The base rules of the contract, in possessive form, which matches the same.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign.
LOOSE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What a loose token of a kind looks like once brackets, quotes and stops around it are gone.
LOOKS = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]{0,4}(?:[:.][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9][0-9.\-/]{10,22}[0-9]$",
    "phone": r"^\(?[0-9][0-9().\-/]{5,20}[0-9]$",
}
#: A pattern's least confidence, its least number of different trusted instances, and the change of a score below
#: which the rounds have settled.
CONFIDENT, SUPPORT, SETTLED = 0.8, 3, 1e-4
#: Characters on either side of a match that are searched for the neighbouring word.
CONTEXT = 80


def _found(text: Column, pattern: str) -> Column:
    """Array of (i, gap, value, left, right): matches in order, what lies before, the words around.

    Splitting by the same pattern gives the text between the matches, and so their places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    count = F.size(values)
    zipped = F.arrays_zip(
        values.alias("value"),
        F.slice(between, F.lit(1), count).alias("before"),
        F.slice(between, F.lit(2), count).alias("after"),
    )

    def one(z: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("i"),
            F.length(z["before"]).alias("gap"),
            z["value"].alias("value"),
            F.lower(F.regexp_extract(F.right(z["before"], F.lit(CONTEXT)), r"(\S+)\s+$", 1)).alias("left"),
            F.lower(F.regexp_extract(F.left(z["after"], F.lit(CONTEXT)), r"^\s+(\S+)", 1)).alias("right"),
        )

    return F.when(count > 0, F.transform(zipped, one))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of card numbers: every second digit from the right doubled, its digits added."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    ip = value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _placed(found: DataFrame) -> DataFrame:
    """Adds start and end, in code points, to rows (row, kind, i, gap, value)."""
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(along)
    return found.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - size)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind -> matches, loose matches) of every row; a table."""
    text = F.col("text")
    held = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    columns = [
        (F.when(held[k], _found(text, PATTERNS[k])) if k in held else _found(text, PATTERNS[k])).alias(k)
        for k in KINDS
    ]
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *columns, _found(text, LOOSE).alias("loose")
    )
    return staged(rows, "scan")


def base_spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left, right) of the matches that pass their check."""
    kinds = [
        scanned.select("row", F.lit(k).alias("kind"), F.explode(k).alias("m")).select("row", "kind", "m.*")
        for k in KINDS
    ]
    placed = _placed(reduce(DataFrame.unionByName, kinds))
    return placed.filter(_valid(F.col("kind"), F.col("value"))).drop("i", "gap")


def loose_spans(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left, right): tokens that look like an identifier of the kind."""
    tokens = scanned.select("row", F.lit("").alias("kind"), F.explode("loose").alias("m"))
    placed = _placed(tokens.select("row", "kind", "m.*")).drop("i", "gap", "kind")
    core = F.regexp_extract("value", r"""^["'(<\[{]*(.*?)["')>\]}.,;:!?]*$""", 1)
    opened = F.length(F.regexp_extract("value", r"""^["'(<\[{]*""", 0))
    placed = placed.withColumn("value", core).withColumn("start", F.col("start") + opened)
    placed = placed.withColumn("end", F.col("start") + F.length("value"))
    n = F.length(_digits(F.col("value")))
    enough = {"email": F.lit(True), "ip": n >= 4, "card": n.between(12, 19), "phone": n.between(7, 15)}
    fits = [F.when(F.col("value").rlike(LOOKS[k]) & enough[k], F.lit(k)) for k in KINDS]
    return placed.withColumn("kind", F.explode(F.array_compact(F.array(*fits))))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of the whole corpus, split at white space and lower-cased."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _edges(spans: DataFrame, trusted: bool) -> DataFrame:
    """(kind, side, word, value, trusted, times): how often a pattern stands beside an instance."""
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.col("left").alias("word")),
        F.struct(F.lit("right").alias("side"), F.col("right").alias("word")),
    )
    rows = spans.select("kind", F.lower("value").alias("value"), F.explode(sides).alias("s"))
    rows = rows.select("kind", "s.side", "s.word", "value").filter("word <> ''")
    counted = rows.groupBy("kind", "side", "word", "value").agg(F.count(F.lit(1)).alias("times"))
    return counted.withColumn("trusted", F.lit(trusted))


def score_patterns(
    seeds: DataFrame,
    unseen: DataFrame,
    words: DataFrame,
    confident: float = CONFIDENT,
    support: int = SUPPORT,
    settled: float = SETTLED,
) -> DataFrame:
    """(kind, side, word) of the patterns to extract with.

    Every round computes all scores anew from those before. They start at the seeds and only rise, since a
    pattern gains confidence and support with the scores beside it and an instance gains with its best pattern; so
    the rounds reach a fixed point, and they go on until no score rises by ``settled`` or more.
    """
    edges = _edges(seeds, True).unionByName(_edges(unseen, False))
    keys = ["kind", "side", "word"]
    reach = edges.groupBy(*keys).agg(
        F.sum("times").alias("all_times"), F.count_distinct("value").alias("instances")
    )
    # Even with every instance trusted, the rest of the patterns would stay below the thresholds.
    able = reach.filter(F.col("instances") >= support).join(words, "word")
    able = able.filter(F.col("all_times") / (F.col("n") + 1) >= confident).select(*keys, "n")
    graph = staged(edges.join(able, keys), "graph")
    trust = graph.select("kind", "value", F.col("trusted").cast("double").alias("score"))
    trust = trust.groupBy("kind", "value").agg(F.max("score").alias("score"))

    def scored(trust: DataFrame) -> DataFrame:
        """The patterns beside enough trusted instances, with their confidence."""
        sure = F.when(F.col("score") >= confident, F.col("value"))
        rows = graph.join(trust, ["kind", "value"]).groupBy(*keys).agg(
            (F.sum(F.col("times") * F.col("score")) / (F.max("n") + 1)).alias("confidence"),
            F.count_distinct(sure).alias("support"),
        )
        return rows.filter(F.col("support") >= support).drop("support")

    while True:
        best = graph.join(scored(trust), keys, "left").groupBy("kind", "value").agg(
            F.greatest(F.max(F.col("trusted").cast("double")), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score")
        )
        old, trust = trust.withColumnRenamed("score", "old"), staged(best, "trust")
        rise = trust.join(old, ["kind", "value"]).agg(F.max(F.col("score") - F.col("old"))).first()[0]
        if rise is None or rise < settled:
            break
    return scored(trust).filter(F.col("confidence") >= confident).select(*keys)


def discovered_spans(seeds: DataFrame, loose: DataFrame, words: DataFrame, **options) -> DataFrame:
    """(row, kind, start, end) of loose tokens beside confident patterns, clear of all base spans."""
    taken = seeds.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    free = loose.join(taken, "row", "left").filter(
        F.coalesce(
            ~F.exists("taken", lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"])), F.lit(True)
        )
    )
    free = staged(free.drop("taken"), "unseen")
    good = score_patterns(seeds, free, words, **options)
    sides = [
        free.join(
            good.filter(F.col("side") == side).select("kind", F.col("word").alias(side)), ["kind", side], "left_semi"
        ).select("row", "kind", "start", "end")
        for side in ("left", "right")
    ]
    # One token may fit several kinds; the first listed gets it.
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    both = sides[0].unionByName(sides[1]).withColumn("order", order)
    return both.groupBy("row", "start", "end").agg(F.min_by("kind", "order").alias("kind"))


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"].cast("int")), s["start"], s["end"])
    )
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    scanned = scan(docs, id_col, text_col)
    seeds = staged(base_spans(scanned), "seeds")
    more = discovered_spans(seeds, loose_spans(scanned), word_counts(docs, text_col), **options)
    both = seeds.select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(
        more.select("row", "kind", "start", "end", F.lit(False).alias("base"))
    )
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(kind_no.alias("kind_no"), "start", "end")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    grouped = both.groupBy("row").agg(
        *counts,
        F.collect_list(F.when(F.col("base"), span)).alias("base_spans"),
        F.collect_list(span).alias("all_spans"),
    )
    return scanned.select("row", "doc_id").join(grouped, "row", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )
