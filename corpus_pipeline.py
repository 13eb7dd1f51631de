"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of documents.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorumspark.llm import bpe, decontaminate, lines, minhash, quality
from quorumspark.llm._graph import shared_folder


def quality_rules(spark, docs, sf_dir):
    """Reject failed and depleted documents; remove boilerplate lines from the others."""
    return quality.clean(docs)


def line_dedup(spark, docs, sf_dir):
    """Remove repeated chunks of lines; documents of which nothing is left go."""
    return lines.dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    return minhash.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without an overlap with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.round_trip(docs, path, public_tokenizers.PATTERN))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can express neither the sampling nor the merges: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
