"""Work of op5 and op10 grows with the words and lines, not with the square of a text's length."""

import time

from pyspark.sql import functions as F

from seqbin.llm import decontaminate, lines


def _seconds(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _word_docs(spark, texts: int, words: int):
    """Texts of numbered words in one partition, so that only the length differs."""
    word = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.concat(F.lit("w"), (i % 997).cast("string")))
    return spark.range(texts).coalesce(1).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"))


def test_decontaminate_is_linear_in_the_length_of_a_text(spark):
    item = " ".join(f"w{i}" for i in range(100, 120))
    benchmark = spark.createDataFrame([("a", item), ("b", "w5 w6 w9")], "item_id string, text string")
    run = lambda docs: _seconds(lambda: decontaminate.contamination(docs, benchmark))
    run(_word_docs(spark, 4, 2000))
    short, long = run(_word_docs(spark, 160, 2000)), run(_word_docs(spark, 1, 320_000))
    assert long < 3 * short + 2
    got = decontaminate.contamination(_word_docs(spark, 1, 320_000), benchmark).first()
    # 997 numbers repeat: 320 whole rounds of them and 960 words more
    assert (got.n_words, got.n_hit, got.n_items) == (320_000, 321 * 20, 1)


def test_windows_at_chunk_ends(spark):
    """Every place of a window in a text is found, by broadcast and by shuffle, at every text length."""
    gram = [f"g{i}" for i in range(10)]
    rows, want = [], {}
    for at in range(0, 150, 3):
        tail = at % 7
        rows.append((at, " ".join(["x"] * at + gram + ["y"] * tail)))
        want[at] = (at + 10 + tail, 10)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([("a", " ".join(gram))], "item_id string, text string")
    for limit in (1000, 0):
        got = decontaminate.contamination(docs, benchmark, broadcast_windows=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit) for r in got} == want


def _line_docs(spark, texts: int, count: int):
    line = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.concat(F.lit("this is line number "), i.cast("string"))
    )
    return spark.range(texts).coalesce(1).select(
        F.col("id").alias("doc_id"), F.array_join(line, "\n").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source")
    )


def test_line_removal_is_linear_in_the_lines_of_a_text(spark):
    run = lambda docs: _seconds(lambda: lines.line_report(docs))
    run(_line_docs(spark, 8, 100))
    short, long = run(_line_docs(spark, 400, 400)), run(_line_docs(spark, 4, 40_000))
    assert long < 3 * short + 2
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.line_report(_line_docs(spark, 4, 40_000)).collect()}
    assert got == {0: (40_000, 0), **{i: (40_000, 40_000) for i in (1, 2, 3)}}


def test_rows_of_a_hot_line_go_to_many_tasks(spark):
    """One line on every document: the rows that meet it are spread over the partitions."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.lit("one line on every page").alias("text"),
        F.concat(F.lit("s"), F.col("id") % 9).alias("source"),
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lines.repeated_rows(lines.line_rows(docs))
        sizes = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        report = lines.line_report(docs).agg(F.sum("n_removed")).first()[0]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert report == 3999
