"""A content-addressed WARC archive: payloads once, record headers apart.

Payload bytes are stored once under their SHA-256; every record keeps its exact
header block and the digest of its payload. On reading, every stored payload is hashed again and
must match its address. The original records are rebuilt by joining headers and payloads
on the digest: payloads are placed by digest when they are written (buckets), so reading
moves the headers to them and never a payload.

Of the records with equal payloads of ``REVISIT_BYTES`` or more, the one with the
smallest page_id is the ``response``; the others are ``revisit`` records without a
payload that refer to it. Smaller payloads are always responses.

Layout of an archive (Parquet, written by Spark's committers):

* ``payloads-<n> (digest binary, payload binary)``, one row per distinct payload, in n
  buckets of the digest,
* ``records (page_id, digest, header binary, revisit, size)``, one row per record.

Defined cases: a null html is an empty payload; rows without a page_id cannot be addressed
and are left out; rows that repeat a page_id are records of their own, with ids of their
own, also where they repeat its html; very long payloads are hashed and moved once in the
JVM; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbin.operators.indexing import with_group_position
from seqbin.operators.skew import join_one
from seqbin.staging import stage

#: payloads from this size on are stored as revisits when they repeat
REVISIT_BYTES = 100
#: every record of an archive carries this date, so the same pages give the same archive
DATE = "2024-01-01T00:00:00Z"


def _hex(digest: str = "digest") -> Column:
    return F.lower(F.hex(F.col(digest)))


def _record_id(page: Column, copy: Column) -> Column:
    """A urn:uuid made from the page id, the digest and the number among equal records."""
    h = F.sha2(F.concat_ws(":", F.lit("page"), page.cast("string"), _hex(), copy.cast("string")).cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(first: Column) -> Column:
    """The header block of a record; ``first`` is the page_id it refers to, or null."""
    revisit = first.isNotNull()
    # line breaks would end the field: each is percent-encoded by its own code
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("copy"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), _hex()),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(first, F.lit(0)))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), first.cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http-payload"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
        F.lit("\r\n"),
    ]
    return F.concat_ws("\r\n", *lines).cast("binary")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``(page_id, url, html)`` as an archive below ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = (
        pages.filter("page_id is not null")
        .select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
        .withColumn("digest", F.unhex(F.sha2("payload", 256)))
    )
    metas = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "digest", F.length("payload").cast("long").alias("size"))
    metas = stage(metas, "warc-pages")
    groups = stage(metas.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size")), "warc-groups")
    shared = groups.filter((F.col("n") > 1) & (F.col("size") >= REVISIT_BYTES)).select("digest", "first")
    # equal records of one page are told apart by their number
    numbered = with_group_position(metas, ["page_id", "digest"], ["url", "row"], "at", "copy", "copies")
    first = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    numbered = stage(numbered, "warc-numbered")
    join_one(numbered, shared, ["digest"], ["row"], "left").select(
        "page_id", "digest", _header(first).alias("header"), first.isNotNull().alias("revisit"), "size"
    ).write.parquet(f"{path}/records")
    # one row per payload: map-side first, so a payload in a third of the pages crosses once per task
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"payloads_{uuid.uuid4().hex}"
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").option("path", f"{path}/payloads-{buckets}").bucketBy(buckets, "digest").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay


def _payload_table(spark: SparkSession, path: str) -> DataFrame:
    """The payload files as a bucketed table; the number of buckets is in the folder name."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/payloads-*")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    if not found:  # an archive written elsewhere, without buckets
        return spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    location = found[0].getPath().toString()
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(
        f"create table {name} (digest binary, payload binary) using parquet"
        f" clustered by (digest) into {location.rsplit('-', 1)[1]} buckets location '{location}'"
    )
    table = spark.table(name)
    spark.sql(f"drop table {name}")
    return table


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, payload)``, each hashed again; a payload that fails its address raises."""
    good = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    broken = F.concat(F.lit("payload does not match its digest "), _hex())
    return _payload_table(spark, path).select(
        "digest", F.when(good, F.col("payload")).otherwise(F.raise_error(broken).cast("binary")).alias("payload")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record)``: the complete bytes of every WARC record.

    Responses get their payload by a join on the digest, revisits have none. Only payloads
    below ``REVISIT_BYTES`` can have many responses; those are spread over several keys.
    """
    schema = "page_id long, digest binary, header binary, revisit boolean, size long"
    records = spark.read.schema(schema).parquet(f"{path}/records")
    end = F.lit(b"\r\n\r\n")
    payloads = read_payloads(spark, path)
    large = records.filter(~F.col("revisit") & (F.col("size") >= REVISIT_BYTES)).join(payloads, "digest")
    small = records.filter(~F.col("revisit") & (F.col("size") < REVISIT_BYTES))
    small = join_one(small, payloads.filter(F.length("payload") < REVISIT_BYTES), ["digest"], ["page_id", "header"])
    full = large.select("page_id", "header", "payload").unionByName(small.select("page_id", "header", "payload"))
    return full.select("page_id", F.concat("header", "payload", end).alias("record")).unionByName(
        records.filter("revisit").select("page_id", F.concat("header", end).alias("record"))
    )


def parse_records(records: DataFrame) -> DataFrame:
    """Fields and payload of ``(record)`` bytes.

    ``(page_id, type, digest_field, refers_to, content_length, payload)``.
    """
    split_at = F.position(F.lit(b"\r\n\r\n"), F.col("record"))
    head = F.decode(F.substring("record", F.lit(1), split_at - 1), "UTF-8")

    def field(name: str) -> Column:
        value = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(value != "", value)

    return (
        records.select(head.alias("head"), "record", split_at.alias("at"))
        .select(
            field("WARC-Page-ID").cast("long").alias("page_id"),
            field("WARC-Type").alias("type"),
            F.substring(field("WARC-Payload-Digest"), F.lit(8), F.lit(64)).alias("digest_field"),
            field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
            field("Content-Length").cast("long").alias("content_length"),
            "record",
            "at",
        )
        .select(
            "page_id", "type", "digest_field", "refers_to", "content_length",
            F.substring("record", F.col("at") + 4, F.col("content_length").cast("int")).alias("payload"),
        )
    )


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of an archive.

    Every record is rebuilt and parsed; digest and size of a response come from its
    payload bytes, those of a revisit from the response it refers to, which is the one of
    that page with the digest that the revisit names.
    """
    parsed = parse_records(read_records(spark, path)).select(
        "page_id", "type", "refers_to", "digest_field", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha"),
    )
    parsed = stage(parsed, "warc-parsed")
    revisits = parsed.filter("type = 'revisit'").select("page_id", "type", "refers_to", F.col("digest_field").alias("sha"))
    targets = (
        parsed.filter("type = 'response'")
        .select(F.col("page_id").alias("refers_to"), "sha", "size")
        .distinct()
    )
    resolved = join_one(revisits, targets, ["refers_to", "sha"], ["page_id"], "left").select(
        "page_id", "type", "refers_to", "size", "sha"
    )
    return (
        parsed.filter("type = 'response'")
        .select("page_id", "type", "refers_to", "size", "sha")
        .unionByName(resolved)
        .select(
            "page_id",
            F.col("size").alias("payload_bytes"),
            F.col("sha").alias("payload_digest"),
            F.col("type").alias("record_type"),
            "refers_to",
        )
    )


ORACLE = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as size, sha256(encode(coalesce(html, ''))) as digest from pages),
g as (select digest, min(page_id) as first from p group by digest)
select page_id, cast(size as bigint) as payload_bytes, p.digest as payload_digest,
       case when size >= {REVISIT_BYTES} and first < page_id then 'revisit' else 'response' end as record_type,
       case when size >= {REVISIT_BYTES} and first < page_id then first end as refers_to
from p join g on p.digest = g.digest"""
