"""WARC as a content-addressed archive.

Payload bytes are stored once, under their SHA-256 digest; the exact bytes before them, the record's
header and that of its HTTP response, are kept apart, with the digest of their payload.  Original
records come back through a join, and reading parses the records.  All of it is DataFrame functions,
and the archive is a pair of tables below the shared folder; that of the payloads is bucketed by
digest, so that they stay where they are in the join.

Of records with equal payloads of at least ``least`` bytes, that with the smallest (page_id, url) is
the response and the others revisit it; smaller ones are all responses.

Defined results: null html is an empty payload; a null page_id counts as larger than any other, and
what revisits it refers to null; of wholly equal rows one is the response; extra columns are ignored.
The pages do not say when they were fetched: WARC-Date is the ``date`` given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, scratch

LEAST = 0
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits, each four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def _header_value(text: Column) -> Column:
    """Text that cannot end a header line, reversibly."""
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def read_value(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))


def write_archive(pages: DataFrame, least: int = LEAST, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers): payloads(address, payload), headers(address, header), as written and read back."""
    rows = pages.select("page_id", "url", _payload().alias("payload")).withColumn("address", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    # Each map task sends one row for each payload that it holds, so copies do not meet in one task.
    stored = rows.groupBy("address").agg(F.min(order).alias("winner"), F.first("payload").alias("payload"))
    stored = scratch(stored.withColumns({"payload_digest": base32_sha1(F.col("payload")), "size": F.length("payload").cast("long")}), "payloads", by="address")
    same = rows.groupBy("address", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    known = stored.select("address", "winner", "payload_digest", "size")
    each = (
        join_spread(same, known, ["address"], F.struct("page_id", "url"), stored.count(), row_bytes=500)
        .withColumn("wins", F.col("page_id").eqNullSafe(F.col("winner.page_id")) & F.col("url").eqNullSafe(F.col("winner.url")))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .withColumn("response", (F.col("size") < least) | (F.col("wins") & (F.col("copy") == 1)))
    )
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit(_HTTP), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_URN}"), number(F.col("page_id")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("response"), F.lit("")).otherwise(
            F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit(f"<{_URN}"), number(F.col("winner.page_id")), F.lit(">"))))
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(F.col("response"), F.col("size")).otherwise(0)).cast("string")),
        F.lit("\r\n"),
        http,
    )
    headers = scratch(each.select("address", F.encode(header, "UTF-8").alias("header")), "headers")
    return stored.select("address", "payload"), headers


def verified(payloads: DataFrame) -> DataFrame:
    """payloads(address, payload); fails if stored bytes do not match their address."""
    bad = F.raise_error(F.concat(F.lit("payload does not match "), F.col("address")))
    return payloads.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(bad.cast("binary")).alias("payload"))


def parse_headers(headers: DataFrame) -> DataFrame:
    """headers with what their lines say, and the size of a record before its payload and of the payload itself."""
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    urn = lambda name: F.regexp_extract(field(name), rf"<{_URN}(-?\d+)>", 1).try_cast("long")
    http = F.substring_index(F.substring_index(text, "\r\n\r\n", -2), "\r\n\r\n", 1)
    return headers.withColumns(
        {
            "page_id": urn("WARC-Record-ID"), "record_type": field("WARC-Type"), "refers_to": urn("WARC-Refers-To"), "url": read_value(field("WARC-Target-URI")),
            "header_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""), "before": F.length("header"), "stored": field("Content-Length").try_cast("int") - F.octet_length(http) - 4,
        }
    )


def reconstruct(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """The parsed headers with the exact bytes of each original record: header, payload (none in a revisit), two line ends.

    Only responses are joined with payloads, so one that a third of all records revisit is not copied to them.
    """
    h = parse_headers(headers)
    end = F.lit("\r\n\r\n").cast("binary")
    responses = h.where("record_type = 'response'").join(verified(payloads), "address").withColumn("record", F.concat("header", "payload", end)).drop("payload")
    return responses.unionByName(h.where("record_type <> 'response'").withColumn("record", F.concat("header", end)))


def read_archive(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each record: what its header says, with the size and digest of the whole payload as read from a response's record."""
    responses = reconstruct(payloads, headers).where("record_type = 'response'")
    body = F.expr("substring(record, before + 1, stored)")
    read = responses.select("address", F.length(body).cast("long").alias("payload_bytes"), base32_sha1(body).alias("payload_digest"))
    facts = scratch(read.groupBy("address").agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest")), "facts")
    told = parse_headers(headers).select("address", "page_id", "record_type", "refers_to", "url", "header_digest")
    both = join_spread(told, facts, ["address"], F.struct("page_id", "url"), facts.count())
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", (F.col("header_digest") == F.col("payload_digest")).alias("digest_agrees"))
