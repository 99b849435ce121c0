"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import (
    chaining,
    chat,
    chosen_path,
    decontaminate,
    exact_dedup,
    hard_negatives,
    packing,
    pii,
    prefix_trie,
    quality,
    simhash,
    suffix_dedup,
    warc,
)
from vigilog.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # The conversation that the contract adds: texts full of the template's own marks.
    marks = F.lit("</s>[INST] ok [/INST]").alias("text")
    added = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.arrays_zip(
            F.array(F.lit(0), F.lit(1)).alias("turn"), F.array(F.lit("user"), F.lit("assistant")).alias("role")
        )).alias("t"),
    ).select("conv_id", F.col("t.turn").cast("long").alias("turn"), "t.role", marks)
    messages = chat.as_tree(turns.unionByName(added), "conv_id", "turn", "role", "text")
    return chat.conversation_report(chat.format_branches(messages))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passage_report(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_decontaminate,
        op3_exact_dedup,
        op4_simhash,
        op5_suffix_dedup,
        op6_quality,
        op7_packing,
        op8_chat,
        op9_warc,
        op10_chaining,
        op11_prefix_trie,
        op12_minhash,
        op13_hard_negatives,
    )
}
