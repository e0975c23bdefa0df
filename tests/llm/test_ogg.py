import os
import zlib

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import ogg


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1 & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 63, 64, 3999, 4000, 4064, 65024, 65088, 300_032])
def test_round_trip(n):
    payload = os.urandom(n) + bytes(-n % 64 or (0 if n else 64))
    back, times = ogg.decode_payload(ogg.write_ogg(payload))
    assert back == payload
    assert [round(t * ogg.RATE) for t in times] == [min(i + ogg.PACKET, len(payload)) for i in range(0, len(payload), ogg.PACKET)]


def test_checksum_is_the_bitwise_one():
    for data in (b"", b"OggS", os.urandom(999)):
        assert ogg.page_crc(data) == slow_crc(data)


def test_streams_are_interleaved_and_demultiplexed():
    media = ogg.write_ogg(bytes(200_000 // 64 * 64))
    serials = [s for s, *_ in ogg.read_pages(media)]
    assert set(serials) == {ogg.PCM, ogg.META} and serials.index(ogg.META) < len(serials) - 1 and serials[-1] == ogg.PCM
    assert len(ogg.read_ogg(media)[ogg.META]) == 2


@pytest.mark.parametrize("at", [5, 23, 40, -1])
def test_damage_is_found(at):
    media = bytearray(ogg.write_ogg(bytes(range(256)) * 100))
    media[at] ^= 1
    with pytest.raises(ValueError):
        ogg.decode_payload(bytes(media))


def test_a_missing_page_is_found():
    media = ogg.write_ogg(os.urandom(200_000 // 64 * 64))
    sizes = [27 + len(lacing) + len(body) for *_, lacing, body in ogg.read_pages(media)]
    cut = sum(sizes[:3])
    with pytest.raises(ValueError):
        ogg.decode_payload(media[:cut] + media[cut + sizes[3] :])


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "héé"), (3, "héé"), (None, "x" * 200_000)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, media_bytes int").drop("media_bytes")
    out = ogg.decode_media(ogg.encode_media(df)).collect()
    assert len(out) == 5
    for r in out:
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    same = [r for r in out if r.doc_id == 3]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature
    assert ogg.decode_media(ogg.encode_media(df.where(F.lit(False)))).count() == 0


def test_null_files_and_missing_streams(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(ogg.write_ogg(bytes(64))))], "doc_id long, media binary")
    out = {r.doc_id: r for r in ogg.decode_media(df).collect()}
    assert out[1].asDict() == {"doc_id": 1, "media": None, **dict.fromkeys(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))}
    assert out[2].payload_bytes == 64
    pcm, meta = ogg._Stream(ogg.PCM), ogg._Stream(ogg.META)
    samples, texts = b"".join(pcm.pages([(b"head", 0), (b"x" * 64, 64)], True, True)), b"".join(meta.pages([(b"{}", 0)], True, True))
    for media in (b"", samples, texts, b"".join(ogg._Stream(ogg.PCM).pages([(b"head", 0)], True, True)) + texts):
        with pytest.raises(ValueError, match="missing"):
            ogg.decode_payload(media)
