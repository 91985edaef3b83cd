"""The registered queries of the text operators: each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqbin.llm import bpe, decontaminate, grammar, hmm, lines, merkle, minhash, personal, runs, secrets, tokenfile, topk, warc
from seqbin.staging import stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_query("op1_hyperminhash")
def _near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=80)


@_query("op2_rank_queue_bpe")
def _encode(spark, sf_dir):
    return bpe.encode_digests(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@_query("op3_addressable_tokens")
def _token_files(spark, sf_dir):
    return tokenfile.encode_to_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    )


@_query("op4_linked_secrets")
def _secrets(spark, sf_dir):
    return secrets.find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op5_decontaminate", decontaminate.ORACLE)
def _decontaminate(spark, sf_dir):
    return decontaminate.contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


@_query("op6_bit_sliced_top_k", topk.ORACLE)
def _top_k(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


@_query("op7_hidden_markov")
def _language_model(spark, sf_dir):
    return hmm.language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op8_content_archive", warc.ORACLE)
def _archive(spark, sf_dir):
    path = stage_path(spark, "archive")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.archive_report(spark, path)


@_query("op9_toxicity")
def _toxicity(spark, sf_dir):
    return grammar.toxicity(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )


@_query("op10_line_spread", lines.ORACLE)
def _line_spread(spark, sf_dir):
    return lines.line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op11_periodic_runs")
def _periodic_runs(spark, sf_dir):
    return runs.periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op12_weak_supervision_pii")
def _personal(spark, sf_dir):
    return personal.find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query("op13_merkle_manifest")
def _manifest(spark, sf_dir):
    return merkle.manifest_proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
