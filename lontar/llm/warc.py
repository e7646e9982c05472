"""A content-addressed WARC archive.

Payload bytes are stored once, in a table keyed by their SHA-256; exact record headers are stored apart, one for each
page. Reading joins the two: a payload is verified against its strong digest and its length as it is read, and a
record is its header followed by its payload (a revisit's block is empty, as the standard has it, and points to the
response by id). All of it is DataFrame operations; payloads pass a shuffle as they are written and as records are put
together again. A payload that many pages share (the empty page) is dealt in pieces by both joins.

Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is the response and the
others are revisits; smaller payloads are all responses. Null html is an empty payload. Null page_ids stand below all
others; rows that repeat the response's page_id and payload are responses too, each with a record id of its own. Null
urls give an empty target; control characters are dropped from urls. Pages have no time of capture, so WARC-Date is a
parameter. Extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, split_join, stored

LEAST = 0
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex40):
    """Upper-case base32 of a SHA-1 in hex: each five hex digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(8):
        v = F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _id(of):
    """WARC-Record-ID of a row with page_id and rid; the page's id is percent-encoded, so it is one token."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(of["page_id"].cast("string")), F.lit("")), F.lit(":"), of["rid"].cast("string"), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """page_id, strong, record_type, refers_to, top (whether the row is its payload's response of reference), copies (of the payload), header."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = stored(pages.select("page_id", F.monotonically_increasing_id().alias("rid"), F.coalesce("url", F.lit("")).alias("url"), F.octet_length(body).cast("long").alias("payload_bytes"),
                            F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("strong")))
    best = d.groupBy("strong").agg(F.max(F.struct("page_id", "rid")).alias("_best"), F.count(F.lit(1)).alias("copies"))  # null page_ids stand below all
    d = split_join(d, stored(best.withColumn("n", F.col("copies"))), "strong", "n", ("rid",))
    top = F.col("_best.page_id")
    again = (F.col("payload_bytes") >= least) & top.isNotNull() & ~F.col("page_id").eqNullSafe(top)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    rows = [F.lit("WARC/1.1"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", _id({"page_id": F.col("page_id"), "rid": F.col("rid")})),
            line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", "")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
            F.when(~again, line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("strong")))),
            F.when(again, line("WARC-Profile", F.lit(PROFILE))), F.when(again, line("WARC-Refers-To", _id(F.col("_best")))),
            line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"))]
    return d.select("page_id", "rid", "strong", "copies", (F.col("rid") == F.col("_best.rid")).alias("top"), F.concat(F.concat_ws(CRLF, *rows), F.lit(CRLF * 2)).alias("header"))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Writes path/headers (a row for each page) and path/payloads (a row for each distinct payload, and how many records have it)."""
    spark = pages.sparkSession
    records(pages, least, date).write.parquet(f"{path}/headers", compression="zstd")
    # one page of each payload, fetched from the pages by its id and the payload's digest
    one = spark.read.parquet(f"{path}/headers").where("top").select("page_id", "strong", "copies")
    p = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    known = p.join(one.where("page_id IS NOT NULL"), "page_id").where(F.sha2("payload", 256) == F.col("strong")).select("strong", "copies", "payload")
    lost = one.where("page_id IS NULL").select("strong", "copies")  # payloads that only rows without page_id have
    rare = p.where("page_id IS NULL").withColumn("strong", F.sha2("payload", 256)).join(lost, "strong").select("strong", "copies", "payload")
    repeats = not pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    both = known.unionByName(rare)
    both = both.dropDuplicates(["strong"]) if repeats else both
    both.write.parquet(f"{path}/payloads", compression="zstd")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """strong, copies, payload of the stored payloads, each held against its digest as it is read."""
    p = spark.read.parquet(f"{path}/payloads")
    ok = F.when(F.sha2("payload", 256) == F.col("strong"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("strong"))))
    return p.select("strong", "copies", ok.alias("payload"))


def _field(name: str, value: str = "([^\r\n]*)"):
    """A header's field. Lines end at line feeds alone: other line ends of Unicode may be in an url."""
    return F.regexp_extract("header", f"(?md)^{name}: {value}", 1)


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The archive's records, put together from header and payload: page_id, header, record_type, refers_to,
    payload_bytes and payload_digest of the page's payload, record_bytes and record_sha256 of the record as it stands in
    a WARC file (header, block, two line ends); whole: the payload too. A record whose length or digest is not what its
    header says is an error, and so is one without a payload."""
    h = spark.read.parquet(f"{path}/headers")
    kind = _field("WARC-Type")
    to = F.when(kind == "revisit", F.url_decode(_field("WARC-Refers-To", "<urn:page:(.*):\\d+>\r?$")))
    h = h.select("page_id", "rid", "header", "strong", kind.alias("record_type"), to.alias("refers_to"))
    r = split_join(h, verified(spark, path), "strong", "copies", ("rid",), "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    r = r.withColumn("block", block).withColumn("payload_digest", base32(F.sha1("payload")))
    fits = (_field("Content-Length").cast("long") == F.octet_length("block")) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    size = F.when(fits, F.octet_length("payload")).otherwise(F.raise_error(F.concat(F.lit("record and header differ: "), F.col("header"))))
    record = F.concat(F.col("header").cast("binary"), F.col("block"), F.lit((CRLF * 2).encode()))
    out = r.withColumn("payload_bytes", size.cast("long")).withColumn("record_bytes", F.octet_length(record).cast("long")).withColumn("record_sha256", F.sha2(record, 256))
    return out.drop("rid", "strong", "block", *([] if whole else ["payload"]))


def export(spark: SparkSession, path: str, out: str) -> None:
    """WARC files of the archive: each record's header and block, then CRLF CRLF. html is text, so files are text."""
    r = read(spark, path, whole=True)
    block = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    r.select(F.concat("header", block)).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(out)


def report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from an archive written and read back."""
    spark = pages.sparkSession
    path = scratch(spark)
    write(pages.select("page_id", "url", "html"), path, least)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h, sha256(body) AS s FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM d),
b AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT)) AS v FROM t)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
