"""Media columns in an Ogg container.

``encode_ogg`` stores bytes losslessly as unsigned 8-bit samples in one
logical stream and their description in a second one, both multiplexed into
one physical stream of checksummed pages.  ``decode_ogg`` reads such bytes
back: it verifies every page's checksum and sequence number, reassembles
packets from the lacing values across pages, demultiplexes the logical
streams by serial number and derives timestamps from granule positions.

Null and empty texts become one block of 192 spaces.  Equal texts give equal
media bytes: serials derive from the payload.  Corrupt media raise
``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import slices

#: Fixed values of the container: capture pattern, header layout, flags.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

#: The payload is padded with spaces to a multiple of BLOCK bytes.
BLOCK, RATE, PACKET = 192, 8000, 192 * 32
_reversed = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC (polynomial 04c11db7, not reflected, no inversion).

    It is the mirror image of the common reflected CRC, so it is computed by
    zlib over bit-reversed bytes and its result is bit-reversed.
    """
    x = zlib.crc32(page.translate(_reversed), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_reversed), "big")


class StreamWriter:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = HEADER.pack(CAPTURE, 0, flags, granule, self.serial, self.number, 0, len(lacing)) + lacing
        self.number += 1
        crc = checksum(head + body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + body

    def packets(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> Iterator[bytes]:
        """Lay packets, each with the granule position at its end, out on pages of 255 segments at most."""
        lacing, body, done, goes_on = bytearray(), [], -1, False
        for k, (data, granule) in enumerate(packets):
            values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            at = 0
            while values:
                room = 255 - len(lacing)
                part, values = values[:room], values[room:]
                n = sum(part)
                lacing += part
                body.append(data[at : at + n])
                at += n
                if not values:
                    done = granule
                end = k == len(packets) - 1 and not values
                if len(lacing) == 255 or end:
                    flags = CONTINUED * goes_on | FIRST * (first and self.number == 0) | LAST * (last and end)
                    yield self.page(bytes(lacing), b"".join(body), done, flags)
                    goes_on = bool(values)
                    lacing, body, done = bytearray(), [], -1


def encode(payload: bytes) -> bytes:
    """Payload as 8-bit samples, multiplexed with a stream that describes it."""
    seed = zlib.crc32(payload)
    audio, about = StreamWriter(seed), StreamWriter(seed ^ 0x80000001)
    note = b"about8\0" + struct.pack("<QI", len(payload), seed)
    data = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    return b"".join(
        [
            *audio.packets([(b"pcmU8\0" + struct.pack("<IH", RATE, 1), 0)], first=True),
            *about.packets([(b"notes\0", 0)], first=True),
            *about.packets([(note, len(payload))], last=True),
            *audio.packets(data, last=True),
        ]
    )


def demultiplex(media: bytes) -> dict[int, dict]:
    """Serial number -> packets, granule positions at their ends (-1 if none), number of pages, of a physical stream."""
    at, streams = 0, {}
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("truncated page header")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        start, end = at + 27 + n, at + 27 + n + sum(lacing)
        if capture != CAPTURE or version or len(lacing) < n or end > len(media):
            raise ValueError(f"no whole page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        s = streams.get(serial)
        if (s is None) != bool(flags & FIRST):
            raise ValueError("a stream must begin with its first page")
        s = s or streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False})
        if number != s["pages"] or s["ended"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError("pages are missing or out of order")
        s["pages"] += 1
        ended = 0
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s["open"].append(media[start : start + size])
                s["packets"].append(b"".join(s["open"]))
                s["granules"].append(-1)
                s["open"], start, size, ended = [], start + size, 0, ended + 1
        if size or lacing[-1:] == b"\xff":
            s["open"].append(media[start : start + size])
        if ended:
            s["granules"][-1] = granule
        s["ended"] = bool(flags & LAST)
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload, and what the container says of it."""
    streams = demultiplex(media)
    kinds = {s["packets"][0][:6]: s for s in streams.values()}
    audio, about = kinds[b"pcmU8\0"], kinds[b"notes\0"]
    payload = b"".join(audio["packets"][1:])
    rate, channels = struct.unpack_from("<IH", audio["packets"][0], 6)
    size, crc = struct.unpack_from("<QI", about["packets"][1], 7)
    if size != len(payload) or crc != zlib.crc32(payload) or audio["granules"][-1] != len(payload):
        raise ValueError("samples differ from their description")
    stamps = [round(1000 * g / rate) for g in audio["granules"] if g >= 0]
    return payload, {
        "streams": len(streams),
        "pages": sum(s["pages"] for s in streams.values()),
        "packets": sum(len(s["packets"]) for s in streams.values()),
        "channels": channels,
        "rate": rate,
        "last_ms": stamps[-1],
    }


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and its payload: spaces up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK))


def _binary(df: DataFrame, schema: str, fn) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                cols = fn(piece)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def encode_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes of the unpadded text, and ``media``: its Ogg form.  One narrow pass."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(piece):
        sizes, payloads = zip(*(padded(t) for t in piece.column(1).to_pylist()), strict=True)
        return piece.column(0), sizes, [encode(p) for p in payloads]

    return _binary(src, f"id {kind}, n_bytes bigint, media binary", run).withColumnRenamed("id", id_col)


def decode_ogg(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read a ``media`` column back: the verified payload and the features of stream and samples."""
    src = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = src.schema["id"].dataType.simpleString()

    def run(piece):
        rows = []
        for m in piece.column(2).to_pylist():
            payload, about = decode(m)
            x = np.frombuffer(payload, np.uint8)
            counts = np.bincount(x, minlength=256)
            mean = float(counts @ np.arange(256)) / len(x)
            var = float(counts @ np.square(np.arange(256) - mean)) / len(x)
            p = counts[counts > 0] / len(x)
            feature = f"streams={about['streams']};pages={about['pages']};packets={about['packets']};ms={about['last_ms']};mean={mean:.4f};sd={var**0.5:.4f};bits={float(-(p * np.log2(p)).sum()):.4f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        return [piece.column(0), piece.column(1), *map(list, zip(*rows, strict=True))]

    names = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return _binary(src, f"id {kind}, n_bytes bigint, {names}", run).withColumnRenamed("id", id_col)


def media_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: every text stored as media, and what reading it back gives."""
    return decode_ogg(encode_ogg(docs))
