"""The whole pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib

import corpus_pipeline
import pytest

from seqbin.llm import grammar

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
SAME = "same text here to find again"
THREAT = "I will kill you, and we will hurt you too"
NAMES = ["gone", "sketch", "h", "h1", "rep", "score", "hit_doc", "clean", "component", "ids", "words_key", "place", "_piece", "w"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
TEXTS = {0: None, 1: "", 2: "   \n\t ", 3: "a", 4: "one two", 5: LONG, 6: LONG, 7: SAME, 8: SAME, 9: THREAT}


def _documents():
    rows = [(i, t, None, None if i % 2 else "s1", len(t or "")) for i, t in TEXTS.items()]
    rows += [rows[4], rows[7], (None, "text without an id", "en", "s2", None)]
    return [row + (None,) * len(NAMES) for row in rows]


def _tables(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _kept(rows):
    return sorted(((r.doc_id, r.n_tokens > 0, r.decoded_sha256) for r in rows.collect()), key=repr)


def _want(ids):
    texts = {**TEXTS, None: "text without an id"}
    rows = [(i, bool(texts[i]), hashlib.sha256((texts[i] or "").encode()).hexdigest()) for i in ids]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("learned", [True, False])
def test_defined_cases(spark, tmp_path, learned):
    # labels of one class only, or none at all, leave the grammar without insults; threats it knows
    assert grammar.Scorer(grammar.Grammar()).score(THREAT) >= 0.5
    labels = [(0, 1, "x"), (3, 0, None), (4, None, None), (None, 1, None), (3, 0, None)] if learned else []
    items = [(0, "same text here", 7), (1, None, 1), (2, "", 2), (None, "one two", 4), (3, "same text here", None)]
    rows = corpus_pipeline.run(spark, _tables(spark, tmp_path, _documents(), labels, items if learned else []))
    # without benchmark items one of the copies stays, with both rows of its doc_id
    assert _kept(rows) == _want([None, 0, 1, 2, 3, 4, 4, 5] + ([] if learned else [7, 7]))


def test_no_documents(spark, tmp_path):
    rows = corpus_pipeline.run(spark, _tables(spark, tmp_path, [], [(0, 1, None)], [(0, "same text here", 7)]))
    assert rows.count() == 0
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
