"""The exit-node list of an anonymizing network, from its text dump."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.addresses import with_address
from vigilog.functions.text import space_tokens
from vigilog.schemas import EXIT_NODES

# Fixed value: the word that marks an address line, wherever it stands.
ADDRESS_MARK = "ExitAddress"


def _address_lines(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(F.col("value").contains(ADDRESS_MARK))
        .select("value", F.get(space_tokens(F.col("value")), F.lit(1)).alias("ip"))
        .transform(with_address, "ip")
    )


def exit_nodes(lines: DataFrame) -> DataFrame:
    """Exit addresses, each once, with the time the list was read."""
    return (
        _address_lines(lines)
        .filter("_hi is not null")
        .groupBy(F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))
        .agg(F.min("ip").alias("ip"))
        .select("ip", "hi", "lo", F.current_timestamp().alias("retrieved_at"))
    )


def exit_node_rejects(lines: DataFrame, source: str = "exit list") -> DataFrame:
    return (
        _address_lines(lines)
        .filter("_hi is null")
        .select(
            F.lit(source).alias("source"),
            F.col("value").alias("line"),
            F.when(F.col("ip").isNull(), "no address").otherwise("not an address").alias("reason"),
        )
    )


def no_exit_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EXIT_NODES)


def read_exit_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The list at ``path``; no list when nothing is there, so nothing matches."""
    try:
        return exit_nodes(spark.read.text(path))
    except AnalysisException:
        return no_exit_nodes(spark)
