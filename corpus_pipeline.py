"""A training-corpus pipeline: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import bpe, common, decontamination, line_dedup, near_dup, toxicity

#: SQL cannot express a learned grammar nor byte-level BPE; the stages are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one; every document stays, n_chars follows its text."""
    return line_dedup.with_kept_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a key of their own, so that a decision about a row is about no other one of its doc_id."""
    key = common.unused("row_key", docs.columns)
    return common.saved(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that of the smallest doc_id (null is the largest, equal ones are told apart by place).

    Rows without words are in no class and stay.
    """
    keyed, key = _keyed(docs)
    found = near_dup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    members = found.where("n_copies > 1 OR n_links > 0").select(F.col("doc_id").alias(key), "class_id")
    members = common.saved(members.join(keyed.select(key, "doc_id"), key), "members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")
    keepers = members.groupBy("class_id").agg(first).select(F.col(f"first.{key}").alias(key))
    copies = members.select(key).join(keepers, key, "left_anti")
    return keyed.join(copies, key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contamination rule marks go."""
    keyed, key = _keyed(docs)
    found = decontamination.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marked = found.where("contaminated").select(F.col("doc_id").alias(key))
    return keyed.join(marked, key, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of its ids and of the text decoded from them."""
    return bpe.encode_decode(docs, outputs=True, fixed_scan=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in the shared folder and read again, and what it wrote for itself goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(common.scratch_paths())
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        old = [p for p in common.scratch_paths() if p not in before]
        docs = common.saved(made, name.replace(" ", "-"))
        common.discard(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)
