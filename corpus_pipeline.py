"""From raw documents to token ids, in five stages.

Each stage works on all that the stage before it kept, is written as Parquet to
the shared stage folder and read again. All but the last return the columns of
``documents``.

* ``toxicity``: documents that the grammar rejects (score of 0.5 or more) go. The grammar
  is learned from ``labels`` on the documents of this stage, outside of the held-out fold.
* ``line_dedup``: all but the first occurrence of lines that spread over sites go; a
  document that loses all its text goes.
* ``near_dedup``: one document of each group of near copies (five-word shingles,
  similarity of 0.8 or more over chains of links) stays, the one with the smallest doc_id.
* ``decontaminate``: documents that hold a ten-word window of a ``benchmark`` item go.
* ``encode``: ``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)`` of what is left; the
  ids have been decoded again and give the text.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from seqbin.llm import bpe, decontaminate, grammar, lines, minhash  # noqa: E402
from seqbin.staging import stage  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grammar.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers of the other stages are still there: remember and hold less
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, remember=150_000, slice_chars=2_000_000)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("encode", encode),
]

#: a grammar learned from labels and chains of links cannot be stated as SQL here
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
