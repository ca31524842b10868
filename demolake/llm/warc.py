"""Content-addressed WARC archive (operator 7).

``write_archive`` stores every payload once, under its SHA-256, and every
record's exact header bytes apart from it; ``read_archive`` checks each stored
payload against its digest and joins the two into whole records again.

A record is the header block, an empty line, the payload and two line ends. Of
records with equal payloads of at least ``revisit_bytes`` bytes, the one with
the smallest page_id is the response and the others are revisits without a
payload of their own. Smaller payloads, empty ones included, are always
responses; their bytes are stored once all the same.

In a header line ``%``, carriage return and line feed of a url are percent-encoded,
and decoded when records are parsed, so that any url comes back as it was.

Nulls: a null payload is empty, a null url is written empty, a null page_id
sorts after all others and is written empty. Rows that repeat a page_id and its
payload have the same record type.
Extra columns are left out; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demolake.llm.scratch import new_folder

_EOL = "\r\n"


#: What a header line can't hold, in the order in which it is escaped.
_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _captures(pages: DataFrame, payload: str) -> DataFrame:
    bytes_ = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), bytes_.alias("payload"))
    return rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})


def record_headers(captures: DataFrame, owners: DataFrame, *, revisit_bytes: int, date: str) -> DataFrame:
    """The exact header bytes of every record, with the digest under which its payload is stored."""
    rows = captures.drop("payload").join(owners.select("digest", "owner"), "digest")
    response = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("size") < revisit_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    url = _replaced(F.col("url"), _ESCAPES)
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("owner")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("size")).otherwise(0).cast("string")),
        F.lit(_EOL),
    )
    return rows.select(F.encode(header, "UTF-8").alias("header"), "digest", response.alias("response"))


def write_archive(pages: DataFrame, path: str, *, payload: str = "html", revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``<path>/payloads`` (digest, payload: one row per digest) and ``<path>/headers`` (header, digest, response)."""
    captures = _captures(pages, payload)
    rows = captures.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    owners = rows.groupBy("digest").agg(F.min("page_id").alias("owner"), F.min_by("n", F.struct(F.col("page_id").isNull(), "page_id")).alias("n_owner"))
    record_headers(captures, owners, revisit_bytes=revisit_bytes, date=date).write.option("compression", "zstd").parquet(f"{path}/headers")
    held = captures.select("digest", "page_id", "payload").join(owners, "digest").filter(F.col("page_id").eqNullSafe(F.col("owner")))
    one = held.filter("n_owner = 1").select("digest", "payload")
    repeated = held.filter("n_owner > 1").groupBy("digest").agg(F.first("payload").alias("payload"))  # rows that stand twice in pages
    one.unionByName(repeated).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: record (bytes; a revisit's has no payload), digest (as stored), size (of the full payload).

    Fails on a stored payload that doesn't match its digest.
    """
    headers = spark.read.schema("header binary, digest string, response boolean").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    true = F.sha2("payload", 256) == F.col("digest")
    payloads = stored.select("digest", F.when(true, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a stored payload does not match "), F.col("digest"))).cast("binary")).alias("payload"))
    end = F.lit(bytearray(f"{_EOL}{_EOL}".encode()))
    whole = headers.filter("response").join(payloads, "digest").select(F.concat("header", "payload", end).alias("record"), "digest", F.octet_length("payload").cast("long").alias("size"))
    sizes = payloads.select("digest", F.octet_length("payload").cast("long").alias("size"))
    return whole.unionByName(headers.filter(~F.col("response")).join(sizes, "digest").select(F.concat("header", end).alias("record"), "digest", "size"))


def parse_records(records: DataFrame) -> DataFrame:
    """Page_id, record_type, url, refers_to, payload_digest (as the header has it), payload (of responses) and size, from the record bytes."""
    text = F.decode("record", "UTF-8")
    head = F.substring_index(text, f"{_EOL}{_EOL}", 1)
    field = lambda name, pattern: F.regexp_extract(F.concat(head, F.lit(_EOL)), f"{_EOL}{name}: {pattern}{_EOL}", 1)
    rows = records.select(
        "size",
        field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("page"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        _replaced(field("WARC-Target-URI", "([^\r\n]*)"), [(new, old) for old, new in reversed(_ESCAPES)]).alias("url"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("payload_digest"),
        F.expr("substring(record, octet_length(encode(substring_index(decode(record, 'UTF-8'), '\r\n\r\n', 1), 'UTF-8')) + 5)").alias("rest"),
    )
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return rows.select(number("page").alias("page_id"), "record_type", "url", number("refers").alias("refers_to"), "payload_digest", F.when(F.col("record_type") == "response", F.expr("substring(rest, 1, octet_length(rest) - 4)")).alias("payload"), "size")


def op7_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    back = parse_records(read_archive(spark, path))
    return back.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("size")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN n < 100 OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""
