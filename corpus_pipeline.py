"""A training corpus from raw documents: toxic ones go, copies go, secrets are masked, the rest is packed.

Each stage reads what its predecessor wrote. All but the last return the columns of documents,
whatever those are called. Null ids, null and empty texts and empty tables pass through every
stage; of rows that repeat doc_id and text, exact deduplication leaves one.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from veinway.llm.common import removed, shared_dir, table
from veinway.llm.queries import MAX_COST, MAX_DOCS, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity scores reject; null and empty texts and rows without an id are scored too."""
    scored = toxicity.scored_rows(docs.select(near_dedup.row_key().alias("key"), "text"), docs, table(spark, sf_dir, "labels"))
    toxic = scored.filter("score >= 0.5").select("key").distinct()
    return docs.select(F.struct("*").alias("row"), near_dedup.row_key().alias("key")).join(toxic, "key", "left_anti").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each component of near-duplicates, of the smallest doc_id: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicated(docs, words=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks confirmed secrets; every document stays."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048 tokens, 128 documents and bounded attention cost."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), max_docs=MAX_DOCS, max_cost=MAX_COST, remember_mb=100)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: Learned scores and packing are beyond SQL; tests hold each operator against a brute-force version, the stages against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")  # nothing reads it any more
    return docs
