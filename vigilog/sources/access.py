"""Space-separated access-log text to the seven-column table, or to all fields of the grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.text import quoted_tokens, space_tokens, token_text

# Fixed value: a line with fewer tokens is rejected.
MIN_TOKENS = 9


#: The fields of a line of the public server access log, in order, with the types of those that are not text.
FULL_FIELDS = (
    "bucketOwner bucket time ip requester requestId operation key requestUri httpStatus errorCode bytesSent "
    "objectSize totalTime turnAroundTime referrer userAgent versionId hostId signatureVersion cipherSuite "
    "authenticationType hostHeader tlsVersion accessPointArn aclRequired"
).split()
FULL_TYPES = {
    "httpStatus": "int", "bytesSent": "bigint", "objectSize": "bigint", "totalTime": "bigint", "turnAroundTime": "bigint"
}
#: A line that ends before its key is rejected; later fields came with later versions of the log and may be missing.
FULL_LEAST = FULL_FIELDS.index("key") + 1
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"


def read_access_lines(
    spark: SparkSession, path: str, partitions: int | None = None
) -> DataFrame:
    """``value`` lines of every object whose path starts with ``path``.

    The scan sizes its own tasks; ask for ``partitions`` only when the input is
    a few huge compressed objects that no task can split.
    """
    lines = spark.read.text(f"{path}*")
    return lines.repartition(partitions) if partitions else lines


def _tokens() -> Column:
    return space_tokens(F.col("value"))


def parse_access_lines(lines: DataFrame) -> DataFrame:
    """Lines with enough tokens, as seven strings; the date is two tokens."""
    return lines.select(_tokens().alias("t")).filter(F.size("t") >= MIN_TOKENS).select(
        F.col("t")[0].alias("bucketOwner"),
        F.col("t")[1].alias("bucket"),
        F.concat_ws(" ", F.col("t")[2], F.col("t")[3]).alias("date"),
        F.col("t")[4].alias("ip"),
        F.col("t")[5].alias("requester"),
        F.col("t")[7].alias("operation"),
        F.col("t")[8].alias("key"),
    )


def access_rejects(lines: DataFrame, source: str = "access") -> DataFrame:
    """The lines :func:`parse_access_lines` leaves out."""
    return lines.filter(F.size(_tokens()) < MIN_TOKENS).select(
        F.lit(source).alias("source"),
        F.col("value").alias("line"),
        F.concat(
            F.lit("expected at least "),
            F.lit(MIN_TOKENS),
            F.lit(" tokens, found "),
            F.size(_tokens()),
        ).alias("reason"),
    )


def parse_full_lines(lines: DataFrame) -> DataFrame:
    """Lines with all fields up to the key, as the typed fields of the whole grammar.

    A missing field and a dash are null; so is a number or time that is none. ``extra`` holds the tokens after the
    last known field, as they stand, or null.
    """
    tokens = F.col("t")

    def field(i: int, name: str) -> Column:
        text = token_text(F.get(tokens, F.lit(i)))
        if name == "time":
            text = F.try_to_timestamp(text, F.lit(TIME_FORMAT))
        elif name in FULL_TYPES:
            text = text.try_cast(FULL_TYPES[name])
        return text.alias(name)

    known = len(FULL_FIELDS)
    extra = F.when(F.size(tokens) > known, F.array_join(F.slice(tokens, F.lit(known + 1), F.size(tokens)), " "))
    # By way of a generator, so that the filter is not pushed below the split, which would run twice.
    split = lines.select(F.explode_outer(F.array(quoted_tokens(F.col("value")))).alias("t"))
    return split.filter(F.size("t") >= FULL_LEAST).select(
        *(field(i, name) for i, name in enumerate(FULL_FIELDS)), extra.alias("extra")
    )


def full_rejects(lines: DataFrame, source: str = "access") -> DataFrame:
    """The lines :func:`parse_full_lines` leaves out, a null line among them."""
    found = F.coalesce(F.size(quoted_tokens(F.coalesce("value", F.lit("")))), F.lit(0))
    return lines.select("value", found.alias("n")).filter(F.col("n") < FULL_LEAST).select(
        F.lit(source).alias("source"),
        F.col("value").alias("line"),
        F.concat(F.lit(f"expected at least {FULL_LEAST} fields, found "), F.col("n")).alias("reason"),
    )
