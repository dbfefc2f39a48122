"""WARC archives addressed by content (operator 10).

An archive is two tables. `headers` keeps the exact header block of every
record, the HTTP head of its content and the digest of its payload; `payloads`
keeps each payload once, under its SHA-256. Records are put together again by
a join on the digest, and a payload is only believed if its bytes still have
that digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import shared_dir

CRLF = "\r\n"
#: Capture time of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"


# The profile of records that repeat a payload, and the content type of an HTTP response.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"


def _http_head(length: Column) -> Column:
    """The HTTP head of a page that came without one."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF))


def _header_block(record_type: Column, record_id: Column, uri: Column, digest: Column, block_length: Column, refers_to: Column) -> Column:
    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    # A header line cannot hold line ends; a URI writes them as escapes.
    one_line = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", record_type), field("WARC-Record-ID", urn(record_id)), field("WARC-Date", F.lit(NO_DATE)), field("WARC-Target-URI", one_line),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), field("WARC-Refers-To", urn(refers_to)), field("WARC-Profile", F.when(record_type == "revisit", F.lit(REVISIT_PROFILE))),
        field("Content-Type", F.lit(HTTP_RESPONSE)), field("Content-Length", block_length.cast("string")), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 100) -> None:
    """Writes headers/ and payloads/ under path.

    Of records with equal payloads of at least least_bytes, the one with the
    smallest id is the response and the others revisit it; smaller ones are all
    responses. A URI stands in its own column as it came; in the header line
    its line ends are escapes. Null payloads are empty, null URIs have no header line, null ids
    write no id and are never chosen before another. Rows that repeat id and
    payload are written each; each is a response if its id is the chosen one.
    """
    rows = pages.select(F.col(record_id).alias("id"), F.col(uri).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    light = rows.select("id", "uri", "digest", "length", F.xxhash64("payload").alias("check"))
    first = light.groupBy("digest").agg(F.min("id").alias("first_id"), F.min("check").alias("check"), F.max("check").alias("other_check"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    same = (F.col("check") == F.col("other_check")) & (F.col("shortest") == F.col("longest"))
    first = first.select("digest", F.when(same, F.col("first_id")).otherwise(F.raise_error(F.concat(F.lit("different payloads under digest "), "digest"))).alias("first_id"))
    typed = light.join(first, "digest").withColumn("revisit", (F.col("length") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first_id")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    refers = F.when(F.col("revisit"), F.col("first_id"))
    head = _http_head(F.col("length"))
    block_length = F.octet_length(head) + F.when(F.col("revisit"), 0).otherwise(F.col("length"))
    header = _header_block(kind, F.col("id"), F.col("uri"), F.col("digest"), block_length, refers)
    typed.select("id", "uri", F.col("revisit").alias("is_revisit"), "digest", header.alias("header"), head.alias("http")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # One row a digest: the chosen record's, found by (digest, id), which is even however many records share a digest.
    chosen = rows.select("digest", F.col("id").alias("first_id"), "payload").withColumn("key", F.coalesce(F.col("first_id").cast("string"), F.lit("")))
    wanted = first.select("digest", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("key"))
    chosen.join(wanted, ["digest", "key"], "left_semi").dropDuplicates(["digest", "key"]).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """id, uri, is_revisit, header, http, digest, payload, payload_bytes, payload_digest of every record: of the full payload, also of a revisit.

    Each stored payload is hashed and measured once, where it is read, and not
    again for every record that shares it. The payload itself is joined to
    responses only: a revisit has none of its own, so many revisits of one
    page do not multiply it.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    good = F.col("payload_digest") == F.col("digest")
    checked = lambda c: F.when(good, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("payload does not have digest "), "digest"))).alias(c)
    whole = headers.where("not is_revisit").join(payloads.select("digest", *map(checked, ("payload", "payload_bytes", "payload_digest"))), "digest", "left")
    short = headers.where("is_revisit").join(payloads.select("digest", *map(checked, ("payload_bytes", "payload_digest"))), "digest", "left")
    return whole.unionByName(short, allowMissingColumns=True)


def header_field(name: str, header: Column | None = None) -> Column:
    """A field's value in a header block, null if it has none."""
    value = F.regexp_extract(F.col("header") if header is None else header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def record_bytes() -> Column:
    """The record as it stands in a WARC file: header block, content block (HTTP head and, of a response, the payload), two line ends."""
    return F.concat(F.encode(F.concat("header", "http"), "UTF-8"), F.coalesce(F.col("payload"), F.lit(b"")), F.lit(b"\r\n\r\n"))


def parsed_record(record: Column) -> Column:
    """struct(header, http, body) of a record's bytes, cut by its own line ends and Content-Length; nulls if there is no such record.

    Positions are those of the bytes read as Latin-1, one character a byte.
    """
    text = F.decode(record, "ISO-8859-1")
    head = F.instr(text, CRLF + CRLF) + 3
    header = F.decode(F.substring(record, F.lit(1), head), "UTF-8")
    length = header_field("Content-Length", header).cast("int")
    block = F.substring(record, head + 1, length)
    http = F.instr(F.decode(block, "ISO-8859-1"), CRLF + CRLF) + 3
    return F.struct(header.alias("header"), F.decode(F.substring(block, F.lit(1), http), "UTF-8").alias("http"), F.substring(block, http + 1, length).alias("body"))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages as an archive (in the shared folder unless path is given) and reads its records back."""
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_archive(pages, path, **options)
    return read_archive(spark, path)
