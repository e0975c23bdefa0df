"""Media columns: Ogg bitstreams in a binary column.

A payload is kept as unsigned 8-bit samples in packets of one logical stream (``pcm8``), beside a
second logical stream with the header text; pages of the two are interleaved.  Reading verifies
each page's checksum, reassembles packets from the lacing values, demultiplexes the streams by
serial number, and derives timestamps from granule positions.

Defined results: a null text is empty; a payload is padded with zero bytes to a positive multiple
of 64; equal payloads give equal files.  ``read_ogg`` raises ValueError for a wrong checksum, a
missing page, a page out of sequence or an unfinished packet, ``decode_payload`` also for a file without
one of the two streams or without a packet in one.  A null file is read as null in every column.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RATE = 8000
PACKET = 4000
BLOCK = 64
PCM, META = 0x50434D38, 0x4D455441
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """CRC of polynomial 0x04c11db7, no reflection, start 0: zlib's CRC over mirrored bytes, mirrored back."""
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{c:032b}"[::-1], 2)


class _Stream:
    """Lays the packets of one logical stream out in pages of at most 255 lacing values."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], first: bool, last: bool) -> Iterator[bytes]:
        lacing, body, granule, continued = bytearray(), bytearray(), -1, False
        left = sum(len(p) // 255 + 1 for p, _ in packets)
        for data, at in packets:
            values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            done = 0
            for v0 in range(0, len(values)):
                lacing.append(values[v0])
                body += data[done : done + values[v0]]
                done += values[v0]
                left -= 1
                ends = v0 == len(values) - 1
                if ends:
                    granule = at
                if len(lacing) == 255 or left == 0:
                    yield self._page(lacing, body, granule, continued, first and self.number == 0, last and left == 0)
                    lacing, body, granule, continued = bytearray(), bytearray(), -1, not ends

    def _page(self, lacing: bytes, body: bytes, granule: int, continued: bool, first: bool, last: bool) -> bytes:
        kind = continued | first << 1 | last << 2
        head = struct.pack("<4sBBqIII", b"OggS", 0, kind, granule, self.serial, self.number, 0) + bytes([len(lacing)]) + bytes(lacing)
        self.number += 1
        whole = head + bytes(body)
        return whole[:22] + struct.pack("<I", page_crc(whole)) + whole[26:]


def write_ogg(payload: bytes) -> bytes:
    """An Ogg file of two logical streams that holds the payload as 8-bit samples."""
    pcm, meta = _Stream(PCM), _Stream(META)
    head = json.dumps({"codec": "pcm8", "rate": RATE, "channels": 1, "samples": len(payload)}).encode()
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    out = [*pcm.pages([(b"pcm8" + struct.pack("<IQ", RATE, len(payload)), 0)], True, False), *meta.pages([(head, 0)], True, False)]
    tail = list(meta.pages([(hashlib.sha256(payload).digest(), len(payload))], False, True))
    data = list(pcm.pages(packets, False, True))
    half = len(data) // 2
    return b"".join([*out, *data[:half], *tail, *data[half:]])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(serial, number, kind, granule, lacing, body) of each page, its checksum verified."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) < at + 27 or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at {at}")
        _, _, kind, granule, serial, number, crc = struct.unpack_from("<4sBBqIII", media, at)
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        size = 27 + len(lacing) + sum(lacing)
        page = media[at : at + size]
        if len(page) < size or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"wrong checksum at {at}")
        yield serial, number, kind, granule, lacing, view[at + 27 + len(lacing) : at + size]
        at += size


def read_ogg(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """The packets of each logical stream as (data, granule position of the page where it ends)."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, list] = {}
    after: dict[int, int] = {}
    for serial, number, kind, granule, lacing, body in read_pages(media):
        if number != after.get(serial, 0) or bool(kind & 2) != (serial not in after):
            raise ValueError(f"stream {serial:x}: page {number} out of sequence")
        after[serial] = number + 1
        parts = open_.setdefault(serial, [])
        if bool(kind & 1) != bool(parts):
            raise ValueError(f"stream {serial:x}: packet is not continued")
        at = 0
        packets = streams.setdefault(serial, [])
        for v in lacing:
            parts.append(body[at : at + v])
            at += v
            if v < 255:
                packets.append((b"".join(parts), granule))
                parts.clear()
    if any(open_.values()):
        raise ValueError("the last packet is unfinished")
    return streams


def decode_payload(media: bytes) -> tuple[bytes, list[float]]:
    """The payload and the end time in seconds of each of its packets, from granule positions.

    A page's granule position is the sample at which its last finished packet ends; earlier packets
    of that page end as many samples before as the later ones hold.
    """
    streams = read_ogg(media)
    if len(streams.get(PCM, ())) < 2 or not streams.get(META):
        raise ValueError("a stream of samples or its header text is missing")
    (_, *packets), meta = streams[PCM], streams[META]
    payload = b"".join(p for p, _ in packets)
    times, end, page = [0.0] * len(packets), 0, None
    for i in range(len(packets) - 1, -1, -1):
        if packets[i][1] != page:
            page = end = packets[i][1]
        times[i] = end / RATE
        end -= len(packets[i][0])
    if hashlib.sha256(payload).digest() != meta[-1][0]:
        raise ValueError("payload differs from its digest")
    return payload, times


def features(payload: bytes, times: list[float]) -> str:
    """Duration, packets, level, zero crossings and the loudest packet's time of 8-bit samples, as a JSON string."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    square = x.astype(np.int64) ** 2
    starts = np.arange(0, len(x), PACKET)
    energy = np.add.reduceat(square, starts) / np.diff(np.append(starts, len(x)))
    signs = x >= 0
    return json.dumps(
        {
            "seconds": round(times[-1], 6),
            "packets": len(times),
            "rms": round(float(np.sqrt(square.mean())), 6),
            "mean": round(float(x.mean()), 6),
            "crossings": int(np.count_nonzero(signs[1:] != signs[:-1])),
            "loudest_at": round(times[int(energy.argmax())], 6),
        }
    )


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes (of the UTF-8 text) and media (the Ogg file of its padded bytes), which replace columns of these names."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_bytes:bigint,media:binary>")
    def encode(texts: pa.Array) -> pa.Array:
        sizes, files = [], []
        for t in texts:
            payload, n = padded(t.as_py())
            sizes.append(n)
            files.append(write_ogg(payload))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["n_bytes", "media"])

    kept = [c for c in docs.columns if c not in ("n_bytes", "media")]
    return docs.select(F.struct(*kept).alias("row"), encode.asNondeterministic()(F.col(text)).alias("made")).select("row.*", "made.*")


_READ = "payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string"


def decode_media(df: DataFrame) -> DataFrame:
    """df with what is read back from its media column: payload size and digests, the file's, and the feature string.

    Columns of these names are replaced.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf(f"struct<{_READ}>")
    def decode(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            media = f.as_py()
            if media is None:
                rows.append((None,) * 6)
                continue
            payload, times = decode_payload(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, times)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds, strict=True)], [x.split(":")[0] for x in _READ.split(",")])

    made = {x.split(":")[0] for x in _READ.split(",")}
    return df.select(F.struct(*[c for c in df.columns if c not in made]).alias("row"), decode.asNondeterministic()(F.col("media")).alias("read")).select("row.*", "read.*")
