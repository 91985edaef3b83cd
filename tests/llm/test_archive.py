"""Archives of pages that repeat an id, a payload or both."""

import hashlib

from seqbin.llm import warc
from seqbin.staging import stage_path

A, B = "a" * 150, "b" * 300


def _archive(spark, rows, name="archive"):
    path = stage_path(spark, name)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    return path


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repeated_page_ids_keep_their_own_payloads(spark):
    path = _archive(spark, [(1, "u", A), (1, "u", B), (2, "v", A), (3, "w", B), (1, "u", A), (4, None, "x"), (5, "", "x")])
    got = sorted(tuple(r) for r in warc.archive_report(spark, path).collect() if r.record_type == "response")
    assert got == [
        (1, 150, _sha(A), "response", None), (1, 150, _sha(A), "response", None), (1, 300, _sha(B), "response", None),
        (4, 1, _sha("x"), "response", None), (5, 1, _sha("x"), "response", None),
    ]
    revisits = sorted(tuple(r) for r in warc.archive_report(spark, path).collect() if r.record_type == "revisit")
    assert revisits == [(2, 150, _sha(A), "revisit", 1), (3, 300, _sha(B), "revisit", 1)]
    records = [bytes(r.record) for r in warc.read_records(spark, path).collect()]
    ids = [line for record in records for line in record.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(records) == 7
    referred = [line.split(b": ")[1] for r in records for line in r.split(b"\r\n") if line.startswith(b"WARC-Refers-To: ")]
    assert {b"WARC-Record-ID: " + r for r in referred} <= set(ids)


def test_line_breaks_in_addresses_stay_apart(spark):
    path = _archive(spark, [(1, "http://a/\rb", A), (2, "http://a/\nb", B), (3, "http://a/\r\nb\n\r", "")])
    found = {r.page_id: bytes(r.record).split(b"\r\n")[4] for r in warc.read_records(spark, path).collect()}
    assert found == {
        1: b"WARC-Target-URI: http://a/%0Db", 2: b"WARC-Target-URI: http://a/%0Ab", 3: b"WARC-Target-URI: http://a/%0D%0Ab%0A%0D",
    }


def test_long_payloads(spark):
    long = "é<p>\r\n\r\n" * 300_000
    path = _archive(spark, [(7, "u", long), (8, "u", long)])
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.archive_report(spark, path).collect()}
    size = len(long.encode())
    assert got == {7: (size, _sha(long), None), 8: (size, _sha(long), 7)}
    bodies = {r.page_id: bytes(r.record) for r in warc.read_records(spark, path).collect()}
    assert bodies[7].split(b"\r\n\r\n", 1)[1] == long.encode() + b"\r\n\r\n"
    assert warc.read_payloads(spark, path).count() == 1


def test_payloads_are_not_moved_again(spark):
    path = _archive(spark, [(i, "u", f"{i} " * 60) for i in range(40)])
    plan = warc.read_records(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = warc.read_records(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in joined
