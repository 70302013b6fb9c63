"""Corpus preparation in five stages, each a DataFrame of documents in and out.

quality        documents whose quality score is below 0.3 go
near_dedup     of every group of near-duplicates (five-word shingles, Jaccard 0.8 and more) the document of the smallest id stays
pii            personal data in the texts is replaced by its kind
mixing         sources are taken to their target weights; a document appears as often as it is taken
packing        documents become pieces of sequences of at most 4096 tokens
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.llm import mixing, packing, pii, quality, simhash, similar
from declara.llm.common import fresh
from declara.session import shared_dir

#: Rows score and predict as the registered quality query does.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores ``LEAST_QUALITY`` or more; learned from the labels of documents at hand.

    A null text is scored as an empty one; rows of one id and text are judged alike and all kept or all dropped.
    """
    scores = quality.score_documents(quality.describe(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    who, what, own = fresh(docs, "_doc", "_low", "_digest")
    low = scores.filter(F.col("score") < LEAST_QUALITY).select(F.col("doc_id").alias(who), F.col("digest").alias(what)).distinct()
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return (keyed.join(low, keyed["doc_id"].eqNullSafe(F.col(who)) & (F.col(own) == F.col(what)), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the row of the smallest id; null, empty and blank texts are one class."""
    return simhash.deduplicated(docs, similar.similar_documents(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the texts replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of their sources takes them; texts without a word are not taken."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences; a null text is an empty document."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage),
          ("packing", packing_stage)]

#: Learned scores, fingerprints and tokens are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
