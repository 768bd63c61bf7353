"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's
rows to the shared folder as Parquet and gives them to the next one, so a stage that is run
again starts from files. All stages but the last return the columns of ``docs``, whatever the
names of others; texts change in the first two, and ``n_chars`` with them. A null text fails the
quality rules, and is an empty one to the other stages. Every row is a document of its own:
repeated rows are near duplicates of each other, null ids do no harm. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, packing, quality, simhash
from tidemark.llm.common import documents, materialise


OTHERS = "other_columns"


def _narrow(docs: DataFrame) -> DataFrame:
    """Ids and texts, with the other columns put away where no operator's columns meet them."""
    others = [F.col(f"`{name}`") for name in docs.columns if name not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(None).alias("_"), *others).alias(OTHERS))


def _wide(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs``, with a text of ``found`` and, where there, ``n_chars`` to fit it."""

    def column(name: str) -> Column:
        if name == "n_chars" and text != "text":
            return F.length(text).cast(docs.schema[name].dataType).alias(name)
        if name in ("doc_id", "text"):
            return F.col(text if name == "text" else name).alias(name)
        return F.col(f"{OTHERS}.`{name}`").alias(name)

    return found.select(*map(column, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed; those with none stay as they are."""
    judged = quality.judge(_narrow(docs)).where("kept")
    clean = F.when(F.col("n_failed_lines") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return _wide(judged.withColumn("clean_text", clean), docs, "clean_text")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    found = line_dedup.dedup_lines(_narrow(docs), min_documents=10, min_chars=1)
    return _wide(found, docs, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints."""
    return _wide(simhash.keep_one_each(_narrow(docs), radius=2, shingle_words=3), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_leaks(_narrow(docs), items)
    return _wide(found.where(F.size("leaks") == 0), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

# XXH64 fingerprints and tokenizer ids cannot be worked out in SQL: tests/llm/test_edges.py holds
# the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
