"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqbin.llm import bpe, decontaminate, grammar, hmm, lines, minhash, secrets, tokenfile, topk, warc
from seqbin.staging import stage_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EXTRA = "gone int, sketch string, h1 string, score double, hit_doc long, clean string, component string, ids string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def _rows():
    texts = [None, "", "   \n\t ", "a", "one two", LONG, LONG, "same text here to find again", "same text here to find again"]
    rows = [(i, t, None, None if i % 2 else "s1", len(t or "")) + (None,) * 8 for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, "text without an id", "en", "s2", 18) + (None,) * 8)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(0, "same text here"), (1, None), (2, ""), (None, "one two"), (3, "same text here")], "item_id long, text string"
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (3, 0), (4, None), (None, 1), (3, 0)], "doc_id long, toxic int")


def test_near_duplicates(docs, nothing):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 5).collect()}
    assert got == {
        (None, None, True), (0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True),
        (6, 5, False), (7, 7, True), (8, 7, False),
    }
    assert minhash.near_duplicates(docs, 5).count() == 11
    assert minhash.near_duplicates(nothing, 5).count() == 0
    kept = minhash.drop_near_duplicates(docs, 5)
    assert kept.columns == docs.columns and kept.count() == 9
    assert minhash.drop_near_duplicates(nothing, 5).count() == 0


def test_bpe(docs, nothing):
    got = bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 11
    assert {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert bpe.encode_documents(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, docs, nothing):
    got = tokenfile.encode_to_files(docs, LIBRARY).orderBy("start").collect()
    assert len(got) == 10  # the row without an id has no place
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert got[0].n_tokens == 1 and got[0].start == 0
    assert tokenfile.encode_to_files(nothing, LIBRARY).count() == 0


def test_secrets(docs, nothing):
    got = secrets.find_secrets(docs).collect()
    assert len(got) == 11 and all(r.spans == "" for r in got)
    assert secrets.find_secrets(nothing).count() == 0


def test_decontaminate(docs, nothing, benchmark):
    got = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got[7].n_hit == 3 and got[7].n_items == 2 and got[7].contaminated
    assert got[0].n_words == 0 and not got[0].contaminated and got[4].n_hit == 0
    assert got[5].n_words == 60_000
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 8


def test_top_k(spark):
    rows = [
        (0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (1, None, 1), (2, [0.1, None], 1), (3, [float("nan"), 1.0], 1),
        (4, [float("inf"), 1.0], 1), (5, [], 1), (6, [1.0], 1), (7, [0.5, 0.25], 1), (None, [1.0, 1.0], 1), (50, [1.0, 1.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    got = [tuple(r) for r in topk.top_k(vectors, 5, 50).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 49152), (0, 2, 7, 20480), (50, 1, 0, 49152), (50, 2, 0, 49152), (50, 3, 7, 49152)]
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_language_model(docs, nothing):
    got = hmm.language_model_scores(docs).collect()
    assert len(got) == 11
    empty = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all(r.n_tokens == 1 and r.score < 0 and r.base_score < 0 for r in empty)
    assert [r.held_out for r in got if r.doc_id is None] == [None]
    assert hmm.language_model_scores(nothing).count() == 0


def test_archive(spark):
    page = "<html>" + "x" * 200
    rows = [(3, None, page), (1, "http://a/\r\nb", page), (2, "u", None), (4, "u", ""), (5, "u", "é"), (None, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = stage_path(spark, "archive")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.archive_report(spark, path).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 1, 206)
    assert got[1].record_type == "response" and got[4].payload_bytes == 0 and got[5].payload_bytes == 2
    path = stage_path(spark, "archive")
    warc.write_archive(pages.limit(0), path)
    assert warc.archive_report(spark, path).count() == 0


def test_toxicity(docs, nothing, labels):
    got = grammar.toxicity(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert grammar.toxicity(nothing, labels).count() == 0
    assert grammar.toxicity(docs, labels.limit(0)).count() == 11
    kept = grammar.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 11


def test_lines(docs, nothing):
    got = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert got[0].n_lines == 0 and got[1].n_lines == 1 and got[5].n_removed == 0 and got[6].n_removed == 1
    assert lines.line_report(nothing).count() == 0
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert kept.count() == 10  # the second long text says nothing new
    assert lines.dedup_lines(nothing).count() == 0


def test_drop_toxic_finds_its_column_in_any_case(spark, labels):
    rows = [(i, "plain words of no harm", "fool " * 9) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, other string")
    kept = grammar.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert grammar.drop_toxic(docs.limit(0), labels).count() == 0
