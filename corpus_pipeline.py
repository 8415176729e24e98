"""The corpus pipeline: five stages over `documents`, each an operator of `llm`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that
the stage before it kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import discard, stored
from llm.op1_decontaminate import clean
from llm.op2_packing import digests, pack
from llm.op5_quality import accepted, train
from llm.op8_secrets import redact
from llm.op10_minhash import linked


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, train(docs, labels))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one of the smallest doc_id, rows without
    one last, then of the smallest text_hash. Texts of similarity 0.8 or more are linked.

    Repeated rows are a group, also if nothing in it has a doc_id. Rows without words
    stay as they are.
    """
    rows = (linked(docs, 80, 100).where("root is not null")
            .groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    stays = (rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("row"))
        .select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"),
                (F.col("row.n") > 1).alias("_many")))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.where(worded).join(stays, F.col("doc_id").eqNullSafe(F.col("_id"))
                                   & (F.xxhash64("text") == F.col("_hash")))
    once = kept.where("not _many")
    again = kept.where("_many").dropDuplicates(["_id", "_hash"])
    return once.unionByName(again).select(docs.columns).unionByName(docs.where(~worded))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark text."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return digests(pack(docs))


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The tokenizer and the classifier have no counterpart in SQL; tests/llm/test_pipeline.py
#: compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
