"""A corpus from raw documents: five stages, each over all that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() applies them to the documents table, writing each result as Parquet to
the folder the cluster shares and reading it back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.exact_dedup import keep_first
from gridloom.llm.mixing import drawn
from gridloom.llm.near_dedup import keep_one
from gridloom.llm.quality import keep_good
from gridloom.llm.queries import domain_labels
from gridloom.llm.segment import sampled_segmentations

#: Each domain's tokens are to be this multiple of what they are; poor ones are gone by then.
DOMAINS, FACTORS = ("clean", "toxic"), (1.0, 0.0)
#: Near copies share this part of their shingles of so many words; op8's query has a contract of its own.
WIDTH, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, width=WIDTH, percent=PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drawn(docs, domain_labels(spark, sf_dir), DOMAINS, FACTORS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All samples of each text with what they decode to, by falling perturbed log chance, and their number."""
    samples = sampled_segmentations(docs)
    return samples.select("doc_id", "samples", F.size("samples").cast("long").alias("n_samples"))


STAGES = [("quality rules", quality), ("exact dedup", exact_copies), ("MinHash near-dedup", near_copies), ("mixing", mixing), ("SentencePiece", pieces)]

# The stages learn by iteration and sample; SQL can't express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    folder = f"{context.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
