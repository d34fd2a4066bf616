"""Content-addressed web archive.

``write`` keeps two tables in a folder: ``headers``, text files that hold the exact WARC header block of every
record in turn, and ``payloads``, each distinct payload once under its SHA-256. ``read`` parses the header blocks,
joins the payloads by digest and checks every payload against the digest it is stored under; ``records`` puts the
exact records together again.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the
others revisit it; smaller payloads are responses throughout, and are stored once all the same.

Defined results. Null html: the empty payload. Null url: the record has no WARC-Target-URI and reads back as null;
line ends and other control characters in a url are percent-encoded. A null page_id sorts after all others; if no
other record has the payload, its record is the response. Rows that share the smallest page_id are all responses.
Repeated rows each have a record. An empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 100
CRLF = "\r\n"
#: The pages carry no time of capture; a fixed one keeps archives reproducible.
DATE = "2000-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    """A header line, or null where its value is."""
    return F.concat(F.lit(name + ": "), value)


def _safe(url: Column) -> Column:
    """Control characters and blanks percent-encoded."""
    return F.when(url.rlike("[\\x00-\\x20\\x7F]"), F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike("[\\x00-\\x20\\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")).otherwise(url)


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    return own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))


def plan_records(own: DataFrame, least: int = LEAST) -> DataFrame:
    """For each row page_id, url, payload_bytes, payload_digest: its record_type and refers_to. Payloads stay out of the shuffle."""
    narrow = own.select("page_id", "url", "payload_bytes", "payload_digest")
    first = narrow.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    joined = narrow.join(first.select("payload_digest", "first"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def header_block(planned: DataFrame) -> DataFrame:
    """The header block of each record, without the blank line that ends it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>"))), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", _safe(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), _line("WARC-Refers-To", urn(F.col("refers_to"))), F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"), _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return planned.select(F.concat_ws(CRLF, *lines).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    own = with_digests(pages)
    header_block(plan_records(own, least)).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(f"{path}/headers")
    # One of equal payloads each: any, for their bytes are the same.
    once = own.select("payload_digest", "payload").dropDuplicates(["payload_digest"])
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: header (the exact block) and its fields."""
    raw = spark.read.option("lineSep", CRLF * 2).text(f"{path}/headers").select(F.col("value").alias("header"))
    field = lambda name, pattern: F.regexp_extract("header", f"\\r\\n{name}: {pattern}(?=\\r\\n|$)", 1)
    number = lambda name: F.nullif(field(name, "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("long")
    url = field("WARC-Target-URI", "([^\\r]*)")
    return raw.select(
        "header", number("WARC-Record-ID").alias("page_id"), F.when(F.col("header").contains("\r\nWARC-Target-URI: "), url).alias("url"), field("WARC-Type", "(\\w+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"), number("WARC-Refers-To").alias("refers_to"), field("Content-Length", "([0-9]+)").cast("long").alias("content_length"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_digest, payload; fails on a payload that is not what its digest says."""
    stored = spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    return stored.select(F.when(actual == F.col("payload_digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("payload_digest")))).alias("payload_digest"), "payload")


def index(spark: SparkSession, path: str) -> DataFrame:
    """From the archive: page_id, payload_bytes, payload_digest, record_type, refers_to. Only lengths of verified payloads are joined."""
    sizes = read_payloads(spark, path).select("payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return read_headers(spark, path).join(sizes, "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The exact records: page_id and record, bytes of header block, payload (none in a revisit) and the ends; with the full payload beside it."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "payload_digest")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.select("page_id", "url", F.concat(F.encode("header", "UTF-8"), end, body, end).alias("record"), F.decode("payload", "UTF-8").alias("html"))
