import base64
import hashlib

from pagewarden.llm import warc

ROWS = [(5, "https://a/", "same"), (3, "https://b/%0A", "same"), (9, "https://c/\r\nX: y", None), (8, None, ""), (3, "https://b/%0A", "same"), (None, "https://d/", "same"), (4, "https://e/", "é" * 50_000), (4, "https://f/", "other")]
SCHEMA = "page_id long, url string, html string, address string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)


def test_archive_against_brute_force(spark):
    out = warc.read_archive(*warc.write_archive(frame(spark))).collect()
    groups = {}
    for p, u, h in ROWS:
        groups.setdefault(h or "", []).append((p is None, p or 0, u or "", p))
    want = []
    for text, members in groups.items():
        raw, members = text.encode(), sorted(members)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for k, m in enumerate(members):
            want.append((m[3], len(raw), digest, "revisit" if k else "response", members[0][3] if k else None))
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    assert all(r.digest_agrees for r in out)


def test_small_payloads_are_all_responses(spark):
    out = warc.read_archive(*warc.write_archive(frame(spark), least=5)).collect()
    assert sum(r.record_type == "revisit" for r in out) == 0


def test_records_are_reconstructed(spark):
    payloads, headers = warc.write_archive(frame(spark), date="2024-05-06T07:08:09Z")
    assert payloads.count() == 4
    html = {(p, u or ""): (h or "").encode() for p, u, h in ROWS}
    seen = set()
    for r in warc.reconstruct(payloads, headers).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and lines[b"WARC-Date"] == b"2024-05-06T07:08:09Z" and lines[b"Content-Type"] == b"application/http; msgtype=response"
        assert rest[int(lines[b"Content-Length"]) :] == b"\r\n\r\n"
        http, _, body = rest[: int(lines[b"Content-Length"])].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        assert body == (html[r.page_id, r.url] if r.record_type == "response" else b"")
        seen.add(r.url)
    assert seen == {u or "" for _, u, _ in ROWS}


def test_a_wrong_payload_is_found(spark):
    import pytest
    from pyspark.sql import functions as F

    payloads, headers = warc.write_archive(frame(spark))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(payloads.withColumn("payload", F.concat("payload", F.lit("x").cast("binary"))), headers).collect()


def test_empty(spark):
    assert warc.read_archive(*warc.write_archive(frame(spark, []))).count() == 0
