"""Audit-log objects: catalogue, listing, gzip text scan, un-nesting, typing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.schemas import AUDIT_EVENT

# Fixed value: the name ending of an audit-log object.
OBJECT_SUFFIX = ".json.gz"


def source_catalogue(sources: DataFrame) -> DataFrame:
    """The (bucket, prefix) pairs to read, each once; a prefix may be null."""
    return sources.select("bucket", "prefix").distinct()


def objects_of_sources(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """Audit-log objects of a ``listing(bucket, key)`` that lie under any source.

    The prefix is matched as a string, not as a folder: a key lies under a
    prefix when its first characters are that prefix. So each key is tried at
    every prefix length in use, which makes it an equality join however many
    prefixes a bucket has. Key length bounds the number of lengths.
    """
    wanted = source_catalogue(sources).select(
        F.col("bucket").alias("_b"), F.coalesce("prefix", F.lit("")).alias("_p")
    )
    named = listing.filter(F.col("key").endswith(OBJECT_SUFFIX)).select("bucket", "key").distinct()
    whole = wanted.filter("_p = ''").select(F.col("_b").alias("bucket"))  # all keys of these buckets
    found = named.join(whole, "bucket", "left_semi")
    wanted = wanted.filter("_p <> ''")
    lengths = sorted(r.n for r in wanted.select(F.length("_p").alias("n")).distinct().collect())
    if not lengths:
        return found
    tried = named.join(whole, "bucket", "left_anti").select(
        "bucket", "key", F.explode(F.array(*[F.left("key", F.lit(n)) for n in lengths])).alias("s")
    )
    under = (F.col("bucket") == F.col("_b")) & (F.col("s") == F.col("_p"))
    return found.unionByName(
        tried.join(wanted, under, "left_semi").select("bucket", "key").distinct()
    )


def source_paths(sources: DataFrame, scheme: str = "s3a://") -> list[str]:
    """Glob paths for the file reader: one per configured source, a short list."""
    return sorted(
        f"{scheme}{row.bucket}/{row.prefix or ''}*"
        for row in source_catalogue(sources).toLocalIterator()
    )


def read_lines(
    spark: SparkSession,
    paths: str | list[str],
    tolerant: bool = False,
    suffix: str = OBJECT_SUFFIX,
) -> DataFrame:
    """``value`` lines of all objects below the paths.

    Spark lists the objects and inflates one per task. ``tolerant`` skips
    objects that cannot be opened; otherwise such an object fails the job.
    """
    flag = str(tolerant).lower()
    return (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", flag)
        .option("ignoreMissingFiles", flag)
        .text(sorted(set([paths] if isinstance(paths, str) else paths)))
    )


def _records(line: Column) -> Column:
    return F.from_json(line, "Records array<string>")["Records"]


def unnest_records(lines: DataFrame, *carry: str) -> DataFrame:
    """One row ``event_json`` per element of ``Records``, as its JSON text."""
    return (
        lines.select(*carry, F.explode(_records(F.col("value"))).alias("event_json"))
        .filter("event_json <> ''")
    )


def unnest_all_fields(lines: DataFrame) -> DataFrame:
    """The general form: every child of every root field, as JSON text.

    Scalar root fields have no children and yield nothing. Object keys of the
    text come back sorted, since the text is written from the parsed value.
    """
    root = lines.select(F.try_parse_json("value").alias("root")).filter("root is not null")
    fields = root.lateralJoin(
        root.sparkSession.tvf.variant_explode(F.col("root").outer()).toDF("i", "name", "child")
    ).select("child")
    children = fields.lateralJoin(
        fields.sparkSession.tvf.variant_explode(F.col("child").outer()).toDF("j", "sub", "node")
    )
    return children.select(F.to_json("node").alias("event_json"))


def record_fault(line: Column) -> Column:
    """Why a line yields no events, null for blank lines and for lines that hold a ``Records`` list."""
    reason = F.when(F.try_parse_json(line).isNull(), "not JSON").otherwise("no Records list")
    return F.when((F.trim(line) != "") & _records(line).isNull(), reason)


def line_rejects(lines: DataFrame, source: str = "audit") -> DataFrame:
    """Non-blank lines that hold no readable ``Records`` list, with the reason."""
    faulty = lines.select("value", record_fault(F.col("value")).alias("reason")).filter("reason is not null")
    return faulty.select(F.lit(source).alias("source"), F.col("value").alias("line"), "reason")


def typed_records(lines: DataFrame) -> DataFrame:
    """Columns of the audit-event schema straight from log lines: one parse.

    The columns come out of a generator, so that a filter on them stays above
    the parse instead of repeating it.
    """
    records = F.from_json("value", f"Records array<struct<{AUDIT_EVENT}>>")["Records"]
    return lines.select(F.inline(records))


def typed_events(events: DataFrame, *carry: str) -> DataFrame:
    """The same columns from event texts, next to the original ``event_json``."""
    parsed = F.array(F.from_json("event_json", AUDIT_EVENT))
    return events.select(*carry, "event_json", F.inline(parsed))


def variant_events(events: DataFrame, *carry: str) -> DataFrame:
    """The typed columns and the whole event as ``event``, a VARIANT that any path can be read from.

    ``variant_get(event, '$.any.field[0]', 'string')`` reaches fields that the schema does not know, without another
    look at the text. Text that is not JSON has no event.
    """
    whole = events.select(*carry, "event_json", F.try_parse_json("event_json").alias("event"))
    parsed = F.array(F.from_json("event_json", AUDIT_EVENT))
    return whole.select(*carry, "event", F.inline(parsed))


#: A quoted name, or a type of the variant notation where a type stands.
_NOTATION = re.compile(
    r"`(?:[^`]|``)*`|(?:^|(?<=: )|(?<=<))(OBJECT(?=<)|VARIANT(?=[,>]|$)|VOID(?=[,>]|$))"
)
_TYPES = {"OBJECT": "STRUCT", "VARIANT": "STRING", "VOID": "STRING"}


def _parsed_type(notation: str) -> str:
    """The variant notation of a type as the type parser reads it; names stay as they are."""
    return _NOTATION.sub(lambda m: _TYPES.get(m.group(1), m.group(0)), notation)


def inferred_events(events: DataFrame) -> DataFrame:
    """Columns by inference, for callers who ask for it: one more pass over the text."""
    spark = events.sparkSession
    found = events.select(
        F.schema_of_variant_agg(F.try_parse_json("event_json")).alias("s")
    ).first()
    ddl = _parsed_type(found.s if found and found.s else "OBJECT<>")
    if not ddl.startswith("STRUCT<") or ddl == "STRUCT<>":
        return spark.createDataFrame([], "event_json string")
    return events.select(F.from_json("event_json", ddl).alias("e")).select("e.*")
