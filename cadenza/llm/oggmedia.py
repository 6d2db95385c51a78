"""Media columns as Ogg bitstreams: written, and read back page by page.

A text becomes two logical streams in one physical stream. One carries its bytes, padded with spaces, as
8-bit samples in packets; the other is an index with a packet for the original length and one checksum
for each sample packet. Reading verifies every page's checksum, rebuilds packets from lacing values,
sorts them by serial number, and turns granule positions into times.
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

#: Fixed values of the format: capture pattern, page header, flags of a page.
CAPTURE = b"OggS"
HEADER = "<4sBBqIIIB"
HEADER_BYTES = 27
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

RATE = 8000
FRAME = 192
#: Samples in a packet; not a multiple of 255, so that pages end inside packets.
PACKET = FRAME * 20
SAMPLES_ID, INDEX_ID = b"\x80pcm8\x00", b"\x80index"
OUT_BYTES = 4 << 20

REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0 and without a final XOR.

    zlib's CRC takes the least significant bit first; on bit-reversed bytes it gives this one reversed.
    """
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def write_pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; the first packet, its header, has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), NO_GRANULE, 0

    def close(more: int) -> None:
        nonlocal granule, flags
        flag = flags | (0 if pages else FIRST) | more
        head = struct.pack(HEADER, CAPTURE, 0, flag, granule, serial, len(pages), 0, len(lacing))
        page = bytearray(head + lacing + body)
        page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
        pages.append(bytes(page))
        lacing.clear()
        body.clear()
        granule, flags = NO_GRANULE, 0

    for number, (packet, at) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while values:
            room = 255 - len(lacing)
            if not room:
                close(0)
                flags = CONTINUED if done else 0
                continue
            part, values = values[:room], values[room:]
            lacing += part
            size = sum(part)
            body += packet[done : done + size]
            done += size
        granule = at
        if number == 0 or number == len(packets) - 1:
            close(LAST if number == len(packets) - 1 else 0)
    return pages


def encode(text: str | None) -> bytes:
    """The Ogg bitstream of a text. Equal texts give equal bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))
    serial = zlib.crc32(payload)
    samples = [(SAMPLES_ID + struct.pack("<II", RATE, FRAME), 0)]
    index = [(INDEX_ID + struct.pack("<Q", len(raw)), 0)]
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        samples.append((part, at + len(part)))
        index.append((struct.pack("<I", zlib.crc32(part)), at + len(part)))
    a, b = write_pages(samples, serial), write_pages(index, serial ^ 0xFFFFFFFF)
    # First all header pages, then the streams' pages in turn.
    rest = [x[i] for i in range(1, max(len(a), len(b))) for x in (a, b) if i < len(x)]
    return b"".join([a[0], b[0], *rest])


def read_packets(media: bytes) -> tuple[list[tuple[int, bytes, int | None, bool]], int]:
    """Packets (serial, bytes, granule or None, first of its stream) in order, and damaged pages.

    Bytes that are no page, and pages whose checksum is wrong, count as damage and are skipped, with the
    packets they hold a part of; reading goes on at the next capture pattern.
    """
    packets, damaged, at = [], 0, 0
    open_parts: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    while at < len(media):
        start = media.find(CAPTURE, at)
        if start != at:
            damaged += 1
        if start < 0:
            break
        at = start + len(CAPTURE)
        if start + HEADER_BYTES > len(media):
            damaged += 1
            continue
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from(HEADER, media, start)
        lacing = media[start + HEADER_BYTES : start + HEADER_BYTES + count]
        end = start + HEADER_BYTES + count + sum(lacing)
        page = media[start:end]
        if version or len(lacing) < count or end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            damaged += 1
            continue
        held = open_parts.pop(serial, None) if flags & CONTINUED and expected.get(serial) == number else None
        lost = bool(flags & CONTINUED) and held is None
        part = held if held is not None else bytearray()
        whole, position = [], HEADER_BYTES + count
        for value in lacing:
            part += page[position : position + value]
            position += value
            if value < 255:
                if lost:
                    lost = False
                else:
                    whole.append(bytes(part))
                part = bytearray()
        for i, packet in enumerate(whole):
            timed = granule if i == len(whole) - 1 and granule != NO_GRANULE else None
            packets.append((serial, packet, timed, bool(flags & FIRST) and i == 0))
        if lacing and lacing[-1] == 255 and not lost:
            open_parts[serial] = part
        expected[serial] = number + 1
        at = end
    return packets, damaged


def decode(media: bytes) -> dict:
    """Payload, original length, packet times and damage of a bitstream that ``encode`` wrote."""
    packets, damaged = read_packets(media)
    streams: dict[int, list] = {}
    for serial, packet, granule, first in packets:
        if first:
            streams[serial] = []
        if serial in streams:
            streams[serial].append((packet, granule))
    samples = next((x for x in streams.values() if x and x[0][0].startswith(SAMPLES_ID)), [])
    index = next((x for x in streams.values() if x and x[0][0].startswith(INDEX_ID)), [])
    rate = struct.unpack_from("<I", samples[0][0], len(SAMPLES_ID))[0] if samples else RATE
    length = struct.unpack_from("<Q", index[0][0], len(INDEX_ID))[0] if index else 0
    sums = [struct.unpack("<I", x[0])[0] for x in index[1:] if len(x[0]) == 4]
    parts = [x[0] for x in samples[1:]]
    wrong = sum(zlib.crc32(p) != s for p, s in zip(parts, sums)) + abs(len(parts) - len(sums))
    # A granule position counts the samples up to the end of the last packet that ends on its page.
    times = [g / rate for _, g in samples[1:] if g is not None]
    return {"payload": b"".join(parts), "n_bytes": length, "times": times, "damaged": damaged + wrong,
            "packets": len(parts), "streams": len(streams)}


def features(read: dict) -> str:
    """Duration, mean, root mean square and crossings of the mean level of the samples read."""
    x = np.frombuffer(read["payload"], np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    power = int((x * x).sum())
    above = x >= (int(x.sum()) // n)
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    last = read["times"][-1] if read["times"] else 0.0
    return (
        f"seconds={last:.4f};packets={read['packets']};streams={read['streams']};damaged={read['damaged']};"
        f"mean={int(x.sum()) / n:.4f};rms={(power / n) ** 0.5:.4f};crossings={crossings}"
    )


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the Ogg bitstream of every whole text.

    Null texts count as empty and give 192 spaces; null ids pass through, repeated rows stay, an empty
    table gives no rows, columns other than doc_id and text are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, media, size = 0, [], 0
            for i, text in enumerate(batch.column("text")):
                media.append(encode(text.as_py()))
                size += len(media[-1])
                if size >= OUT_BYTES or i == batch.num_rows - 1:
                    ids = batch.column("doc_id").slice(at, len(media))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], ["doc_id", "media"])
                    at, media, size = i + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, times, damaged, feature) read from the stored bytes of (doc_id, media).

    A null or damaged bitstream gives what could be read of it; ``damaged`` counts pages and packets that
    failed their checks.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("n_bytes", pa.int64()), ("payload", pa.binary()), ("times", pa.list_(pa.float64())),
            ("damaged", pa.int64()), ("feature", pa.string()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ])
        for batch in batches:
            at, rows, size = 0, [], 0
            for i, value in enumerate(batch.column("media")):
                stored = value.as_py() or b""
                read = decode(stored)
                rows.append({k: read[k] for k in ("n_bytes", "payload", "times", "damaged")} | {
                    "feature": features(read), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
                })
                size += len(read["payload"])
                if size >= OUT_BYTES or i == batch.num_rows - 1:
                    part = pa.RecordBatch.from_pylist(rows, schema)
                    ids = batch.column("doc_id").slice(at, len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *part.columns], ["doc_id", *schema.names])
                    at, rows, size = i + 1, [], 0

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(
        each,
        f"doc_id {kind}, n_bytes bigint, payload binary, times array<double>, damaged bigint, feature string,"
        " media_bytes bigint, media_sha256 string",
    )


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return read_media(encode_media(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
