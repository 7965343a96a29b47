"""A media column in Ogg: pages with checksums, packets in lacing values, several logical streams, granule positions.

encode() stores a binary payload of 8-bit samples as an Ogg file of two logical streams. Each stream begins with a header
packet ("FXPCM8", version, stream's number, streams, samples a second, bytes a frame). The payload's frames of 192 samples go to
the streams by turns, one packet each; a page holds up to PAGE_PACKETS packets of its stream, pages of both streams are
interleaved, and each page's granule position is the number of samples that its stream has completed. decode() reads such a
file, and any Ogg file whose packets span pages: it verifies every page's checksum, reassembles packets from lacing values,
demultiplexes the streams by serial number, puts the frames in order, and derives each stream's time from its last granule
position.

The checksum has polynomial 0x04c11db7, the bits of a byte from the highest, and starts with 0. zlib's has the same
polynomial with bits from the lowest, so it is computed there over bytes with reversed bits.

Defined results: a null text is an empty payload; the payload has at least one frame; very long texts are stored whole, one at
a time; damage (a checksum that differs, a missing page, a packet cut off) raises; repeated rows give repeated rows, and equal
payloads equal files: serial numbers come from the payload; ties can't arise; an empty table gives no rows; columns other than
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm.arrays import slices, text_bytes
from fluxframe.llm.tables import table

FRAME = 192
STREAMS = 2
RATE = 48_000
PAGE_PACKETS = 64
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = (1 << 64) - 1
HEADER = struct.Struct("<6sBBBIH")
PAGE = struct.Struct("<4sBBQIIIB")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    """A packet's segment sizes: 255 as often as it goes, then the rest, 0 included."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(kind: int, granule: int, serial: int, number: int, table_: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(table_)) + table_
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def encode(payload: bytes) -> bytes:
    """payload, whose size is a positive multiple of FRAME, as an Ogg file."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload is no positive multiple of {FRAME} bytes")
    base = zlib.crc32(payload) & 0xFFFFFFFE
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    turns = [frames[s::STREAMS] for s in range(STREAMS)]
    out = []
    for s in range(STREAMS):
        head = HEADER.pack(b"FXPCM8", 1, s, STREAMS, RATE, FRAME)
        out.append(page(FIRST | (0 if turns[s] else LAST), 0, base + s, 0, lacing(len(head)), head))
    one = lacing(FRAME)
    for lo in range(0, len(turns[0]), PAGE_PACKETS):
        for s in range(STREAMS):
            part = turns[s][lo : lo + PAGE_PACKETS]
            if part:
                last = lo + len(part) >= len(turns[s])
                out.append(page(LAST if last else 0, (lo + len(part)) * FRAME, base + s, 1 + lo // PAGE_PACKETS, one * len(part), b"".join(part)))
    return b"".join(out)


def streams(data: bytes) -> dict[int, dict]:
    """The logical streams of an Ogg file by serial number: packets, granule position, pages."""
    found: dict[int, dict] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise ValueError("a page is cut off")
        sign, version, kind, granule, serial, number, crc, segments = PAGE.unpack_from(data, at)
        if sign != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        sizes = data[at + PAGE.size : at + PAGE.size + segments]
        body = at + PAGE.size + segments
        end = body + sum(sizes)
        if len(sizes) < segments or end > len(data):
            raise ValueError("a page is cut off")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"the checksum of the page at byte {at} differs")
        if kind & FIRST:
            if serial in found:
                raise ValueError(f"stream {serial} begins twice")
            found[serial] = {"packets": [], "granule": 0, "pages": 0, "open": None, "ended": False}
        stream = found.get(serial)
        if stream is None or stream["ended"] or number != stream["pages"]:
            raise ValueError(f"a page of stream {serial} is missing")
        if bool(kind & CONTINUED) != (stream["open"] is not None):
            raise ValueError("a packet is cut off")
        open_ = [stream["open"]] if stream["open"] is not None else []
        start = body
        for size in sizes:
            body += size
            if size < 255:
                open_.append(bytes(view[start:body]))
                stream["packets"].append(b"".join(open_))
                open_, start = [], body
        stream["open"] = b"".join([*open_, view[start:body]]) if start < body or open_ else None
        stream["pages"] += 1
        stream["ended"] = bool(kind & LAST)
        if granule != NO_PACKET_ENDS:
            if granule < stream["granule"]:
                raise ValueError("granule positions fall")
            stream["granule"] = granule
        at = end
    if any(s["open"] is not None or not s["ended"] for s in found.values()):
        raise ValueError("a stream is cut off")
    return found


def decode(data: bytes) -> tuple[bytes, list[dict]]:
    """The payload of an Ogg file that encode() wrote, and for each stream its number, packets, pages and microseconds."""
    parts: dict[int, list[bytes]] = {}
    told = []
    for serial, s in streams(data).items():
        sign, version, number, count, rate, frame = HEADER.unpack(s["packets"][0])
        if sign != b"FXPCM8" or version != 1 or frame != FRAME:
            raise ValueError("an unknown stream")
        if s["granule"] != sum(map(len, s["packets"][1:])):
            raise ValueError("the granule position differs from the samples")
        parts[number] = s["packets"][1:]
        told.append({"serial": serial, "stream": number, "packets": len(s["packets"]), "pages": s["pages"], "us": s["granule"] * 1_000_000 // rate})
    out: list[bytes] = [b""] * sum(map(len, parts.values()))
    for number, packets in parts.items():
        out[number :: len(parts)] = packets
    return b"".join(out), told


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def with_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of df's doc_id and text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            media = [encode(payload(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(df: DataFrame) -> DataFrame:
    """What the media column's files hold, read back: digests of the payload and the file, and as feature the streams'
    packets, pages and time, and the mean and the range of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows: dict[str, list] = {f.split()[0]: [] for f in FEATURES.split(", ")[2:]}
            for data in batch.column("media").to_pylist():
                back, told = decode(data)
                samples = np.frombuffer(back, np.uint8)
                said = ";".join(f"{t['stream']}:{t['packets']}p/{t['pages']}g/{t['us']}us" for t in sorted(told, key=lambda t: t["stream"]))
                rows["payload_bytes"].append(len(back))
                rows["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(back[-16:]))
                rows["media_bytes"].append(len(data))
                rows["media_sha256"].append(hashlib.sha256(data).hexdigest())
                rows["feature"].append(f"{said};mean={int(samples.sum()) / len(samples):.3f};min={samples.min()};max={samples.max()}")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | rows, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    return df.mapInArrow(run, FEATURES)


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(with_media(table(spark, sf_dir, "documents")))
