"""The corpus pipeline: quality rules, near-duplicate removal, secret scans, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result as
Parquet to the shared folder and reads it back for the next one. All stages but the last return the columns of
documents; the mixture repeats a document as often as it is taken. Empty tables, null texts and repeated rows behave
as the operators say; columns beyond those of documents pass through all stages but the last, whatever their names. No
SQL expresses BPE, so the tests hold run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, registry, rules, secrets
from tidemark.llm.common import count_words, new_path, save

#: Near duplicates share so many percent of their shingles.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return rules.cascade(rows).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the least id."""
    return neardup.without_near_duplicates(docs, percent=PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets marked out of the texts."""
    ledger = secrets.Ledger(spark, new_path(spark, "pipeline-ledger"))
    secrets.scan_unseen(docs, ledger, path="doc_id")
    found = save(secrets.summary(ledger), "pipeline-found").select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    both = docs.join(secrets.small_findings(found, "_found"), secrets.blob("text") == F.col("_blob"), "left")
    clean = F.when(F.col("_found").isNotNull(), secrets.redacted(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    return both.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    key = mixing.order_key("doc_id", registry.MIX_SEED)
    sized = save(docs.select("source", count_words("text").alias("size"), key.alias("key")), "pipeline-sized")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", key.alias("key"))
    taken = mixing.apply(rows, mixing.plan(sized)).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), registry.vocabulary_path()).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mixture),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
