"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.llm import (
    alignment,
    conversations,
    decontaminate,
    line_dedup,
    lm,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    suffix,
    tool_calls,
    wavelet,
)
from tidemark.llm.common import documents, materialise

QUALITY_COLUMNS = (
    "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
    "n_failed_lines lost_words"
).split()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(*QUALITY_COLUMNS)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return wavelet.read_digests(wavelet.write_shards(documents(spark, sf_dir), path))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), order=3, backoff=0.4, min_count=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir), min_documents=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(documents(spark, sf_dir), min_bytes=400)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in a document."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_leaks(documents(spark, sf_dir), items)
    return found.select("doc_id", F.inline("leaks"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir), radius=2, shingle_words=3)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


# What the turns of the given conversations would send to a tool, and its schema.
LOOKUP = {
    "lookup": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": 300},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
        },
        "required": ["query", "limit"],
        "additionalProperties": False,
    }
}


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given turns as tool traffic: a user's turn calls ``lookup`` with its text and as
    limit its number of words, after the call two turns before; the assistant's turn that
    follows is the result."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")

    def name(turn: Column) -> Column:
        return F.concat(F.lit("call_"), turn.cast("string"))

    words = F.size(F.split(F.trim("text"), r"\s+"))
    calls = turns.where("role = 'user'").select(
        "conv_id",
        name(F.col("turn")).alias("call_id"),
        "turn",
        F.lit("lookup").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array()).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return tool_calls.link_calls(calls, results, LOOKUP)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(documents(spark, sf_dir), path)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations, damaged by a rule and repaired."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = conversations.counted(conversations.damage(turns))
    summaries = materialise(conversations.repairs(rows), "repairs")
    hashed = conversations.digests(conversations.repaired(rows, summaries))
    hashed = hashed.withColumnRenamed("conv_id", "repaired_id")
    both = summaries.join(hashed, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    nothing = F.sha2(F.lit(""), 256)
    return both.drop("repaired_id").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", nothing)
    )


ALIGNMENT_COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(documents(spark, sf_dir), *paths).select(*ALIGNMENT_COLUMNS)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))

    def how_many(kind: int) -> Column:
        own = F.filter("base", lambda span: span[0] == kind)
        return F.size(own).cast("long").alias(f"n_{pii.KINDS[kind]}")

    return found.select(
        "doc_id",
        *map(how_many, range(len(pii.KINDS))),
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_sharding": op8_sharding,
    "op9_tool_calls": op9_tool_calls,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_personal_data": op13_personal_data,
}
ORACLES: dict[str, str] = {}
