"""The packet codec. Headers in bulk are decoded and encoded on whole Arrow batches in NumPy (decode_headers,
encode_headers): a header is cut off in the JVM, so payloads don't travel, and its words are read as one matrix. The same
as single expressions (decode_axis, decode_packed) serves where one field is needed. Frames and payloads are built and
parsed by native expressions.

A decoded column has a fixed type. Unsigned 64-bit words are bit patterns in BIGINT.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from fluxframe.functions.bits import ipv4_text, mac_text, ones_complement_16, s16
from fluxframe.operators.validate import HEADER_BYTES, first_of
from fluxframe.plans.views import CRC_TABLE, captures, crc_sql, packets, samples, sql, stepped

# Fields of the wire header as (name, word, lowest bit, bits).
AXIS_FIELDS = [
    ("magic", 0, 32, 32), ("version", 0, 16, 16), ("header_bytes", 0, 0, 16), ("board_id", 1, 48, 16), ("stream_type", 1, 32, 16), ("epoch_mode", 1, 16, 16),
    ("flags", 1, 0, 16), ("unix_sec", 2, 0, 64), ("pps_count", 3, 0, 64), ("sample0", 4, 0, 64), ("frame_id", 5, 0, 64), ("seq_no", 6, 32, 32), ("chan0", 6, 0, 32),
    ("chan_count", 7, 48, 16), ("time_count", 7, 32, 16), ("ninput", 7, 16, 16), ("payload_format", 7, 0, 16), ("scale_id", 8, 32, 32), ("payload_bytes", 8, 0, 32),
    ("product_id", 9, 48, 16), ("nchan", 9, 32, 16), ("block_index", 9, 16, 16), ("block_count", 9, 0, 16), ("pfb_taps", 10, 48, 16), ("fft_shift", 10, 32, 16),
    ("spec_status_flags", 10, 0, 32), ("spec_sample_rate_hz", 11, 32, 32), ("scale_mode", 11, 16, 16), ("spec_half_band", 11, 0, 1), ("sync_generation", 12, 0, 64),
    ("observation_tag", 13, 0, 64), ("signal_chain_tag", 14, 32, 32), ("schedule_tag", 14, 0, 32), ("mts_id", 15, 32, 32), ("sync_status", 15, 0, 32), ("header_crc", 15, 0, 32),
]


def little(data: Column, at: int | Column, size: int) -> Column:
    """size bytes of data from at (0-based) as a little-endian integer; 8 bytes give a bit pattern."""
    at = F.lit(at) if isinstance(at, int) else at
    return big(F.concat(*[F.substring(data, at + k + 1, F.lit(1)) for k in reversed(range(size))]), 0, size)


def big(data: Column, at: int | Column, size: int) -> Column:
    """size bytes of data from at as a big-endian integer."""
    at = F.lit(at) if isinstance(at, int) else at
    text = F.hex(F.substring(data, at + 1, F.lit(size)))
    if size < 8:
        return F.conv(text, 16, 10).cast("long")
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def words_of(data: Column, count: int = 16) -> list[Column]:
    """The first little-endian 64-bit words of data: bytes are turned once for all words."""
    return [little(data, 8 * k, 8) for k in range(count)]


def decode_axis(data: Column) -> Column:
    """The wire header at the start of data as a struct."""
    words = words_of(data)

    def field(word: int, low: int, bits: int) -> Column:
        return words[word] if bits == 64 else F.shiftrightunsigned(words[word], low).bitwiseAND(F.lit((1 << bits) - 1))

    return F.struct(*[field(w, low, bits).alias(n) for n, w, low, bits in AXIS_FIELDS])


# The secondary packed header, little-endian, in order of its bytes; version 3 has the sync words.
PACKED = "<IHHHHHHQQQQIIHHHHII"
PACKED_FIELDS = ("magic", "version", "header_bytes", "board_id", "stream_type", "epoch_mode", "flags", "unix_sec", "pps_count", "sample0", "frame_id", "seq_no", "chan0", "chan_count", "time_count", "ninput", "payload_format", "scale_id", "payload_bytes")
PACKED_SYNC = ("sync_generation", "observation_tag", "signal_chain_tag", "schedule_tag", "mts_id", "sync_status")


def decode_packed(data: Column) -> Column:
    """The packed header; a chan0 of 0 falls back to the global input at bytes 80 to 83; sync fields are null before version 3."""
    out, at = {}, 0
    for name, code in zip(PACKED_FIELDS, PACKED[1:], strict=True):
        size = struct.calcsize("<" + code)
        out[name] = little(data, at, size)
        at += size
    out["chan0"] = F.when(out["chan0"] == 0, little(data, at, 4)).otherwise(out["chan0"])
    at += 4
    for name, size in zip(PACKED_SYNC, (8, 8, 4, 4, 4, 4), strict=True):
        out[name] = F.when(out["version"] >= 3, little(data, at, size))
        at += size
    return F.struct(*[c.alias(n) for n, c in out.items()])


#: name -> NumPy type of the packed header, with the global input after its fields, and the sync words.
_PACKED_TYPE = np.dtype([(n, f"<u{struct.calcsize('<' + c)}") for n, c in zip((*PACKED_FIELDS, "global_input0", *PACKED_SYNC), PACKED[1:] + "IQQIIII", strict=True)])


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column, a row a value."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray | int:
    """A column as unsigned words, null as 0; 0 if there is none."""
    at = batch.schema.get_field_index(name)
    if at < 0:
        return np.uint64(0)
    return pc.fill_null(pc.cast(batch.column(at), pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)


def encode_headers(df: DataFrame, layout: str = "axis", to: str = "header") -> DataFrame:
    """df with a binary header of its columns; absent columns and nulls are 0."""
    if layout not in ("axis", "packed"):
        raise ValueError(f"layout {layout}")

    def axis(batch: pa.RecordBatch) -> np.ndarray:
        words = np.zeros((batch.num_rows, HEADER_BYTES // 8), "<u8")
        for name, word, low, bits in AXIS_FIELDS:
            words[:, word] |= (_numbers(batch, name) & np.uint64((1 << bits) - 1)) << np.uint64(low)
        return words.view(np.uint8)

    def packed(batch: pa.RecordBatch) -> np.ndarray:
        rows = np.zeros(batch.num_rows, _PACKED_TYPE)
        new = _numbers(batch, "version") >= 3
        for name in _PACKED_TYPE.names:
            rows[name] = np.where(new | (name not in PACKED_SYNC), _numbers(batch, name), np.uint64(0)).astype(_PACKED_TYPE[name])
        out = np.zeros((batch.num_rows, HEADER_BYTES), np.uint8)
        out[:, : _PACKED_TYPE.itemsize] = rows.view(np.uint8).reshape(batch.num_rows, _PACKED_TYPE.itemsize)
        return out

    make = {"axis": axis, "packed": packed}[layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, _binary(make(batch))], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def decode_headers(df: DataFrame, data: str = "packet", layout: str = "axis", fields: list[str] | None = None) -> DataFrame:
    """df's other columns and the header's fields (all, or those named) as columns; null where data is shorter than a header.
    A chan0 of 0 in the packed layout falls back to the global input, and its sync fields are null before version 3."""
    every = [n for n, *_ in AXIS_FIELDS] if layout == "axis" else [n for n in _PACKED_TYPE.names if n != "global_input0"]
    wanted = every if fields is None else fields
    rest = [c for c in df.columns if c != data and c not in wanted]
    where = {n: (w, low, bits) for n, w, low, bits in AXIS_FIELDS}

    def columns(rows: np.ndarray, ok: np.ndarray) -> Iterator[pa.Array]:
        if layout == "axis":
            words = rows.view("<u8")
            for n in wanted:
                w, low, bits = where[n]
                yield pa.array((words[:, w] >> np.uint64(low) & np.uint64((1 << bits) - 1)).view(np.int64), mask=~ok)
            return
        head = np.ascontiguousarray(rows[:, : _PACKED_TYPE.itemsize]).view(_PACKED_TYPE)[:, 0]
        for n in wanted:
            x = np.where(head[n] == 0, head["global_input0"], head[n]) if n == "chan0" else head[n]
            yield pa.array(x.astype(np.uint64).view(np.int64), mask=~ok | ((n in PACKED_SYNC) & (head["version"] < 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("_head")
            ok = pc.fill_null(pc.equal(pc.binary_length(column), HEADER_BYTES), False).to_numpy(zero_copy_only=False)
            rows = np.zeros((batch.num_rows, HEADER_BYTES), np.uint8)
            rows[ok] = np.frombuffer(b"".join(column.filter(pa.array(ok)).to_pylist()), np.uint8).reshape(-1, HEADER_BYTES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns(rows, ok)], names=[*rest, *wanted])

    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, T.LongType()) for n in wanted)])
    return df.select(*rest, F.substring(data, 1, HEADER_BYTES).alias("_head")).mapInArrow(run, schema)


def parse_frame(frame: Column, base: int = 4300, count: int = 24, strict: bool = False) -> Column:
    """Ethernet, IPv4 and UDP of a frame: error (null: none), addresses, ports, payload. The fast form takes options and
    ignores the checksum; the strict one wants a header of 20 bytes with a right checksum, and any port."""
    size = F.length(frame)
    first = big(frame, 14, 1)
    ihl = first.bitwiseAND(F.lit(15))
    udp = F.lit(14) + (F.lit(5) if strict else ihl) * 4
    dst = big(frame, udp + 2, 2)
    length = big(frame, udp + 4, 2)
    checks = [
        (size < 42, "FrameTooShort"),
        (big(frame, 12, 2) != 0x0800, "NonIpv4Ethernet"),
        ((F.shiftright(first, 4) != 4) | ((ihl != 5) if strict else (ihl < 5)), "UnsupportedIpv4Header"),
        (size < udp + 8, "TruncatedIpv4Udp"),
        (big(frame, 23, 1) != 17, "NonUdpIpv4"),
    ]
    checks += [(ones_complement_16(F.array(*[big(frame, 14 + 2 * k, 2) for k in range(10)])) != 0, "UnsupportedIpv4Header")] if strict else [(~dst.between(base, min(65535, base + max(1, count) - 1)), "WrongUdpDstPort")]
    checks += [((length < 8) | (size < udp + length), "BadUdpLength")]
    error = first_of(*checks)
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(
        error.alias("error"), ok(mac_text(big(frame, 0, 6))).alias("dst_mac"), ok(mac_text(big(frame, 6, 6))).alias("src_mac"), ok(ipv4_text(big(frame, 26, 4))).alias("src_ip"), ok(ipv4_text(big(frame, 30, 4))).alias("dst_ip"),
        ok(big(frame, udp, 2)).alias("src_port"), ok(dst).alias("dst_port"), ok(F.substring(frame, udp + 9, length - 8)).alias("payload"),
    )


def to_bytes(x: Column, size: int, little_: bool = False) -> Column:
    """A number's low bytes, the highest first, or the lowest."""
    text = F.lpad(F.right(F.hex(x.cast("long")), F.lit(2 * size)), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))]) if little_ else text)


def build_frame(payload: Column, src_port: Column, dst_port: Column, dst_mac: int = 0x08C0EBD595B2, src_mac: int = 0x020000000001, src_ip: int = 0x0A000101, dst_ip: int = 0x0A000110) -> Column:
    """An Ethernet frame of one UDP packet, with the IPv4 checksum; a null payload is an empty one."""
    payload = F.coalesce(payload, F.unhex(F.lit("")))
    size = F.length(payload)
    fixed = [0x4500, 0, 0x4000, 64 << 8 | 17, src_ip >> 16, src_ip & 0xFFFF, dst_ip >> 16, dst_ip & 0xFFFF]
    total = size + (28 + sum(fixed))
    folded = F.shiftright(total, 16) + total.bitwiseAND(F.lit(0xFFFF))
    folded = F.shiftright(folded, 16) + folded.bitwiseAND(F.lit(0xFFFF))
    put = lambda x, n: F.unhex(F.lit(f"{x:0{2 * n}X}"))
    return F.concat(
        put(dst_mac, 6), put(src_mac, 6), put(0x08004500, 4), to_bytes(size + 28, 2), put(0x00004000, 4), put(64 << 8 | 17, 2), to_bytes(0xFFFF - folded, 2), put(src_ip, 4), put(dst_ip, 4),
        to_bytes(src_port, 2), to_bytes(dst_port, 2), to_bytes(size + 8, 2), put(0, 2), payload,
    )


def encode_frames(df: DataFrame, payload: str = "payload", to: str = "frame") -> DataFrame:
    """df with Ethernet frames of its payloads, from src_port to dst_port."""
    return df.withColumn(to, build_frame(F.col(payload), F.col("src_port"), F.col("dst_port")))


def beats_to_bytes(words: Column, keep: Column) -> Column:
    """64-bit words (array<bigint>) as bytes, of each word those that its mask in keep marks; the shorter array ends it."""
    pairs = F.slice(F.arrays_zip(words.alias("w"), keep.alias("k")), 1, F.least(F.size(words), F.size(keep)))
    kept = lambda p: F.concat(*[F.when(F.shiftright(p["k"], b).bitwiseAND(F.lit(1)) == 1, F.lpad(F.hex(F.shiftrightunsigned(p["w"], 8 * b).bitwiseAND(F.lit(255))), 2, "0")).otherwise(F.lit("")) for b in range(8)])
    return F.unhex(F.array_join(F.transform(pairs, kept), ""))


def time_offset(beat: Column, sub: Column, channel: Column) -> Column:
    """Where a sample of a TIME payload starts in the packet."""
    return 128 + 8 * (beat * 16 + sub * 4 + F.floor(channel / 2)) + 4 * (channel % 2)


def spec_offset(t: Column, chan: Column, lane: Column, chan_count: Column, ninput: Column) -> Column:
    return 128 + 4 * ((t * chan_count + chan) * ninput + lane)


TIME_SAMPLES = "sample_index long, channel int, i int, q int"


def explode_time(df: DataFrame, decimation: int = 1, channels: list[int] | None = None, packet: str = "packet") -> DataFrame:
    """Samples of TIME packets with columns sample0 and time_count, on Arrow batches: header filters come first, and only
    the channels asked for are unpacked. Packets whose payload is shorter than their count are refused before."""
    wanted = list(range(8)) if channels is None else channels
    keys = [c for c in df.columns if c not in (packet, "sample0", "time_count")]
    df = df.filter(F.length(packet) >= 128 + 128 * F.col("time_count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # 64 packets of 2048 samples at once
                part = batch.slice(lo, 64)
                index, chan, iq, row = [], [], [], []
                for r, (data, s0, beats) in enumerate(zip(part.column(packet).to_pylist(), part.column("sample0").to_pylist(), part.column("time_count").to_pylist(), strict=True)):
                    x = np.frombuffer(data, "<i2", beats * 64, 128).reshape(beats * 4, 8, 2)[:, wanted]
                    index.append(np.repeat(s0 + np.arange(beats * 4) * decimation, len(wanted)))
                    chan.append(np.tile(np.array(wanted, np.int32), beats * 4))
                    iq.append(x.reshape(-1, 2))
                    row.append(np.full(len(index[-1]), r))
                if row:
                    at, both = pa.array(np.concatenate(row)), np.concatenate(iq).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keys), pa.array(np.concatenate(index)), pa.array(np.concatenate(chan)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=[*keys, "sample_index", "channel", "i", "q"])

    return df.mapInArrow(run, T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(TIME_SAMPLES).fields]))


def explode_time_native(df: DataFrame, decimation: int = 1, channels: list[int] | None = None, packet: str = "packet") -> DataFrame:
    """The same in expressions alone; slower, since each sample cuts its own bytes."""
    keys = [c for c in df.columns if c not in (packet, "sample0", "time_count")]
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("time_count") * 4 - 1))).withColumn("channel", F.explode(F.array(*map(F.lit, channels or range(8)))))
    at = time_offset(F.floor(F.col("k") / 4), F.col("k") % 4, F.col("channel")).cast("int")
    return df.select(*keys, (F.col("sample0") + F.col("k") * decimation).alias("sample_index"), "channel", s16(little(F.col(packet), at, 2)).alias("i"), s16(little(F.col(packet), at + 2, 2)).alias("q"))


def explode_spec(df: DataFrame, packet: str = "packet") -> DataFrame:
    """Cells of SPEC packets with columns chan0, chan_count, time_count and ninput: t, chan, input, i, q."""
    keys = [c for c in df.columns if c not in (packet, "chan0", "chan_count", "time_count", "ninput")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # 64 packets of 2048 cells at once
                part = batch.slice(lo, 64)
                chan0, c, t, n = (np.asarray(part.column(x).to_numpy(zero_copy_only=False), np.int64) for x in ("chan0", "chan_count", "time_count", "ninput"))
                count = t * c * n
                iq = np.concatenate([np.zeros((0, 2), "<i2"), *(np.frombuffer(p, "<i2", 2 * k, 128).reshape(-1, 2) for p, k in zip(part.column(packet).to_pylist(), count.tolist(), strict=True))]).astype(np.int32)
                row = np.repeat(np.arange(part.num_rows), count)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                per, lanes = (c * n)[row], n[row]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keys), pa.array((cell // per).astype(np.int32)), pa.array(chan0[row] + cell // lanes % c[row]), pa.array((cell % lanes).astype(np.int32)), pa.array(iq[:, 0]), pa.array(iq[:, 1])], names=[*keys, "t", "chan", "input", "i", "q"])

    df = df.filter(F.length(packet) >= 128 + 4 * F.col("chan_count") * F.col("time_count") * F.col("ninput"))
    return df.mapInArrow(run, T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string("t int, chan long, input int, i int, q int").fields]))


@udtf(returnType="k int, channel int, i int, q int")
class TimePayload:
    """Samples of one TIME payload, for SQL: SELECT ... FROM t, LATERAL time_payload(packet, time_count)."""

    def eval(self, packet: bytes, time_count: int):
        x = np.frombuffer(packet, "<i2", time_count * 64, 128).reshape(time_count * 4, 8, 2)
        for k in range(time_count * 4):
            for c in range(8):
                yield k, c, int(x[k, c, 0]), int(x[k, c, 1])


@udtf(returnType="t int, chan long, input int, i int, q int")
class SpecPayload:
    """Cells of one SPEC payload: SELECT ... FROM t, LATERAL spec_payload(packet, chan0, chan_count, time_count, ninput)."""

    def eval(self, packet: bytes, chan0: int, chan_count: int, time_count: int, ninput: int):
        cells = chan_count * time_count * ninput
        for k, (i, q) in enumerate(np.frombuffer(packet, "<i2", 2 * cells, 128).reshape(-1, 2).tolist()):
            yield k // (chan_count * ninput), chan0 + k // ninput % chan_count, k % ninput, i, q


def register(spark: SparkSession) -> None:
    spark.udtf.register("time_payload", TimePayload)
    spark.udtf.register("spec_payload", SpecPayload)


def build_packets(spark_rows: DataFrame, beats: int = 4) -> DataFrame:
    """TIME packets whose sample of beat b, sub-sample s and channel c is i = 100 b + 10 s + c and q = -i, after a header of
    the rows' columns."""
    b, s, c = np.meshgrid(np.arange(beats), np.arange(4), np.arange(8), indexing="ij")
    i = 100 * b + 10 * s + c
    body = np.stack([i, -i], axis=-1).astype("<i2").tobytes()
    return encode_headers(spark_rows).select("*", F.concat("header", F.lit(body)).alias("packet")).drop("header")


def packetise(df: DataFrame, beats: int) -> DataFrame:
    """Samples (n, channel, i, q of all eight channels) as TIME payloads of `beats` beats: frame_id, sample0, payload. An
    incomplete packet at the end isn't sent."""
    each = beats * 4
    df = df.select(F.floor(F.col("n") / each).alias("frame_id"), F.col("n"), "channel", "i", "q")
    rows = df.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("n", "channel", "i", "q"))).alias("x"), F.min("n").alias("sample0"))
    return rows.filter(F.size("x") == each * 8).select("frame_id", "sample0", iq_bytes("x").alias("payload"))


def iq_bytes(pairs: str) -> Column:
    """An array of structs with i and q as little-endian 16-bit pairs."""
    def half(v: Column) -> Column:
        text = F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFF))), 4, "0")
        return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))

    return F.unhex(F.array_join(F.transform(pairs, lambda v: F.concat(half(v["i"]), half(v["q"]))), ""))


def tiled(df: DataFrame, nchan: int, chans: int, taps: int) -> DataFrame:
    """Cells of spectra (frame, bin, input, i, q) with their block: chans neighbouring channels each, numbered within the frame.
    sample0 is that of the oldest frame that went into the filter bank's window."""
    block = F.expr(f"cast(bin div {chans} as int)")
    return df.withColumns({"block_index": block, "block_count": F.lit(nchan // chans), "chan0": (block * chans).cast("long"), "sample0": (F.col("frame") - (taps - 1)) * nchan})


def packetise_spectra(cells: DataFrame, nchan: int, chans: int, taps: int, ninput: int = 8, chan_split: int = 1 << 31, **header) -> DataFrame:
    """Spectra (frame, bin, input, i, q) as SPEC packets of one time and `chans` channels: frame, block_index, sample0, seq_no,
    packet. A packet's payload has a cell for each channel and input, inputs together; blocks with cells missing aren't
    sent. frame_id and seq_no count packets, block by block; a sync_generation in header makes it version 3."""
    blocks = tiled(cells, nchan, chans, taps).groupBy("frame", "block_index", "block_count", "chan0", "sample0").agg(F.array_sort(F.collect_list(F.struct("bin", "input", "i", "q"))).alias("x"))
    blocks = blocks.filter(F.size("x") == chans * ninput)
    number = F.col("frame") * F.col("block_count") + F.col("block_index")
    fixed = {"magic": 0x54353130, "version": 3 if header.get("sync_generation") else 2, "header_bytes": HEADER_BYTES, "stream_type": 0, "chan_count": chans, "time_count": 1, "ninput": ninput, "payload_bytes": 4 * chans * ninput, "product_id": 0xF101, "nchan": nchan, "pfb_taps": taps} | header
    rows = blocks.withColumns({"frame_id": number, "seq_no": number.bitwiseAND(F.lit(0xFFFFFFFF)), "spec_half_band": (F.col("chan0") >= chan_split).cast("int"), "_payload": iq_bytes("x"), **{n: F.lit(v).cast("long") for n, v in fixed.items()}}).drop("x")
    return encode_headers(rows).select("frame", "block_index", "sample0", "seq_no", F.concat("header", "_payload").alias("packet"))


def dac_samples(df: DataFrame) -> DataFrame:
    """Complex samples of captured 128-bit words (words: array of struct lo, hi): four a word, the lowest first, as capture,
    sample (its number), lane, i, q."""
    w = df.select("capture", F.posexplode("words").alias("k", "w")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(3))))
    w = w.withColumn("_c", F.expr("shiftrightunsigned(case when lane < 2 then w.lo else w.hi end, lane % 2 * 32)"))
    return w.select("capture", (F.col("k") * 4 + F.col("lane")).cast("long").alias("sample"), "lane", s16(F.col("_c").bitwiseAND(F.lit(65535))).alias("i"), s16(F.shiftrightunsigned("_c", 16).bitwiseAND(F.lit(65535))).alias("q"))


def witness_words(df: DataFrame, channel: int) -> DataFrame:
    """Samples of one channel from captured 64-bit words (words: array<bigint>): four words a beat, two channels each."""
    w = df.select("capture", F.posexplode("words").alias("k", "word")).filter(F.col("k") % 4 == channel // 2)
    half = F.shiftrightunsigned("word", 32 * (channel % 2))
    return w.select("capture", F.expr("k div 4").alias("beat"), s16(half.bitwiseAND(F.lit(65535))).alias("i"), s16(F.shiftright(half, 16).bitwiseAND(F.lit(65535))).alias("q"))


def metadata_with_fallback(df: DataFrame) -> DataFrame:
    """Values of a live snapshot where it is coherent, else of the stored one; 0 counts as absent."""
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b))
    live = (F.col("live_ok") == 1) & (F.col("live_count") > 0)
    return df.select("e", F.when(live, F.col("live_seq")).otherwise(F.col("snap_seq")).alias("seq"), pick("count", "fallback_count").alias("count"), F.coalesce(F.col("name"), F.when(F.col("code") == 1, "100").when(F.col("code") == 2, "200"), F.lit("unknown")).alias("profile"))


_HEADER = ["magic", "version", "header_bytes", "board_id", "stream_type", "flow_id", "sample0", "frame_id", "seq_no", "chan0", "chan_count", "time_count", "ninput", "payload_format", "payload_bytes", "product_id", "nchan", "block_index", "block_count", "pfb_taps", "spec_status_flags"]


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("e", *_HEADER).withColumns({"sync_generation": F.lit(0x1234567890ABCDEF).cast("long") - F.col("e"), "observation_tag": -F.col("e"), "mts_id": F.lit(0x9ABC)})


def q_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = decode_headers(encode_headers(_headers(spark, sf_dir)).select("e", "header"), "header")
    out = h.select("e", *("magic", "version", "header_bytes", "board_id", "stream_type", "sample0", "frame_id", "seq_no", "chan0", "chan_count", "time_count", "product_id", "block_index", "spec_status_flags", "sync_generation", "observation_tag", "mts_id"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("version", "header_bytes", "stream_type", "block_index")})


def q_axis_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields by single expressions."""
    h = encode_headers(_headers(spark, sf_dir)).select("e", decode_axis(F.col("header")).alias("h"))
    return h.select("e", *[F.col(f"h.{n}").alias(n) for n in ("magic", "version", "seq_no", "sample0", "chan0", "spec_status_flags", "observation_tag")])


def q_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _headers(spark, sf_dir).withColumn("global_input0", F.col("e") % 7)
    h = decode_headers(encode_headers(df, "packed").select("e", "header"), "header", "packed")
    native = encode_headers(df, "packed").select("e", decode_packed(F.col("header")).alias("h")).select("e", F.col("h.chan0").alias("chan0_native"), F.col("h.sync_generation").alias("sync_native"))
    return h.select("e", "magic", "version", "seq_no", "sample0", "chan0", "payload_bytes", "sync_generation", "mts_id").join(native, "e")


def q_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of each packet with masks of kept bytes; the masks are one fewer now and then."""
    e = F.col("e")
    words = F.array(e * 0x0102030405, -e, e + 7)
    keep = F.array(*[((e * k) % 256).cast("int") for k in (3, 5, 7)])
    return packets(spark, sf_dir).select("e", F.hex(beats_to_bytes(words, F.when(e % 4 == 0, F.slice(keep, 1, 2)).otherwise(keep))).alias("bytes"))


def q_spec_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter bank's frames of 16 channels as packets of four channels each, parsed again."""
    from fluxframe.operators.dsp import PFB_TEST, q_pfb

    cells = q_pfb(spark, sf_dir).select("frame", F.col("phase").alias("bin"), F.col("channel").alias("input"), "i", "q")
    out = packetise_spectra(cells, PFB_TEST, 4, 4, chan_split=8, sync_generation=5)
    head = decode_headers(out.select("packet", F.hex(F.substring("packet", F.lit(129), F.lit(128))).alias("payload")), "packet", fields=["version", "sample0", "frame_id", "seq_no", "chan0", "block_index", "block_count", "spec_half_band"])
    return head


def q_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.col("i").bitwiseAND(F.lit(65535)).bitwiseOR(F.shiftleft(F.col("q").bitwiseAND(F.lit(65535)), 16))
    c = captures(spark, sf_dir).select("capture", F.expr("n div 4").alias("w"), (F.col("n") % 4).alias("l"), pair.alias("p"))
    part = lambda k: F.max(F.when(F.col("l") == k, F.col("p")))
    both = lambda k: part(k).bitwiseOR(F.shiftleft(part(k + 1), 32))
    words = c.groupBy("capture", "w").agg(both(0).alias("lo"), both(2).alias("hi")).groupBy("capture").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "lo", "hi"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("words"))
    return dac_samples(words)


def q_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames built, damaged here and there, and parsed by both parsers."""
    df = encode_frames(packets(spark, sf_dir).select("e", "src_port", "dst_port", F.unhex(F.lpad(F.hex("e"), 16, "0")).alias("payload")))
    f = F.col("frame")
    damaged = F.when(F.col("e") % 13 == 0, F.substring(f, F.lit(1), F.lit(40))).when(F.col("e") % 17 == 0, F.concat(F.substring(f, F.lit(1), F.lit(12)), F.unhex(F.lit("86DD")), F.substring(f, F.lit(15), F.lit(999)))).when(F.col("e") % 19 == 0, F.concat(F.substring(f, F.lit(1), F.lit(24)), F.unhex(F.lit("0000")), F.substring(f, F.lit(27), F.lit(999)))).when(F.col("e") % 23 == 0, F.substring(f, F.lit(1), F.length(f) - 1)).otherwise(f)
    p = df.withColumn("frame", damaged).select("e", parse_frame(F.col("frame"), 4300, 20).alias("fast"), parse_frame(F.col("frame"), strict=True).alias("strict"))
    return p.select("e", F.col("fast.error").alias("fast_error"), F.col("strict.error").alias("strict_error"), "fast.src_ip", "fast.dst_mac", "fast.dst_port", F.hex("fast.payload").alias("payload"))


def _summed(df: DataFrame) -> DataFrame:
    """Per packet and channel: samples, first and last index, and sums that tell their order."""
    k = F.col("sample_index") % 64
    return df.groupBy("e", "channel").agg(F.count("*").alias("samples"), F.min("sample_index").alias("first"), F.max("sample_index").alias("last"), F.sum(F.col("i") * k).alias("i_by_place"), F.sum("q").alias("sum_q"))


def q_time_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("e", "sample0", "seq_no", F.lit(4).alias("time_count"))
    return _summed(explode_time(build_packets(df).select("e", "sample0", "time_count", "packet"), 2, [0, 3, 7]))


def q_time_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("e", "sample0", "seq_no", F.lit(4).alias("time_count"))
    return _summed(explode_time_native(build_packets(df).select("e", "sample0", "time_count", "packet"), 2, [0, 3, 7]))


def q_spec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = np.stack([np.arange(64), -np.arange(64)], axis=-1).astype("<i2").tobytes()
    df = encode_headers(packets(spark, sf_dir).select("e", F.col("block_index").cast("long").alias("chan0"), F.lit(4).alias("chan_count"), F.lit(2).alias("time_count"), F.lit(8).alias("ninput")))
    out = explode_spec(df.select("e", "chan0", "chan_count", "time_count", "ninput", F.concat("header", F.lit(body)).alias("packet")))
    return out.groupBy("e", "t").agg(F.count("*").alias("cells"), F.sum(F.col("i") * F.col("chan")).alias("i_by_chan"), F.sum(F.col("q") * F.col("input")).alias("q_by_input"))


def q_packetise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packetise(samples(spark, sf_dir), 4)
    return out.select("frame_id", "sample0", F.length("payload").alias("bytes"), s16(little(F.col("payload"), 0, 2)).alias("first_i"), s16(little(F.col("payload"), 510, 2)).alias("last_q"))


def q_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("i").bitwiseAND(F.lit(65535)).bitwiseOR(F.shiftleft(F.col("q").bitwiseAND(F.lit(65535)), 16))
    df = captures(spark, sf_dir).groupBy("capture").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", word.bitwiseOR(F.shiftleft(word, 32)).alias("w")))), lambda x: x["w"]).alias("words"))
    return witness_words(df, 5)


def q_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    df = packets(spark, sf_dir).select("e", (e % 2).alias("live_ok"), (e % 3).alias("live_count"), (e + 1).alias("live_seq"), (-e).alias("snap_seq"), (e % 5).alias("count"), (e % 11).alias("fallback_count"), F.when(e % 4 == 0, "named").alias("name"), (e % 3).alias("code"))
    return metadata_with_fallback(df)


def q_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of canonical JSON and of bytes: CRC-32 with 0 read as 1, SHA-256, and the ones' complement sum."""
    js = F.to_json(F.struct("board_id", "e", "flow_id"))
    df = packets(spark, sf_dir).withColumn("js", js)
    crc = F.crc32(F.col("js").cast("binary"))
    words = F.array(F.pmod("e", F.lit(65536)), F.pmod(F.col("e") * 7919, F.lit(65536)), F.lit(0xFFFF).cast("long"))
    return df.select("e", F.sha2("js", 256).alias("sha256"), F.when(crc == 0, 1).otherwise(crc).alias("nonzero_crc"), ones_complement_16(words).alias("ones"))


QUERIES = {
    "header_axis": q_axis, "header_axis_native": q_axis_native, "axis_words": q_words, "spec_packetise": q_spec_packets, "dac_witness": q_dac, "header_packed": q_packed, "frame_parse": q_frames, "time_decode": q_time_decode, "time_decode_native": q_time_native, "spec_decode": q_spec_decode,
    "packetise": q_packetise, "witness_decode": q_witness, "metadata_fallback": q_fallbacks, "checksums": q_checksums,
}

_CELL = "b, s, c, 100 * b + 10 * s + c AS i FROM (SELECT unnest(range(4)) AS b), (SELECT unnest(range(4)) AS s), (SELECT unnest([0, 3, 7]) AS c)"
_TIME = "SELECT e, c::INTEGER AS channel, count(*) AS samples, min(x) AS first, max(x) AS last, sum(i * (x % 64))::BIGINT AS i_by_place, sum(-i)::BIGINT AS sum_q FROM (SELECT e, c, i, sample0 + (b * 4 + s) * 2 AS x FROM packets, (SELECT " + _CELL + ")) GROUP BY e, c"
_JS = """'{"board_id":' || board_id || ',"e":' || e || ',"flow_id":' || flow_id || '}'"""
SQL = {
    "checksums": stepped("packets", CRC_TABLE + f", j AS (SELECT e, {_JS} AS js FROM packets), c AS (SELECT e, js, " + crc_sql("list_transform(string_split(js, ''), lambda x: ord(x)::BIGINT)") + " AS crc FROM j, crc_table), w AS (SELECT e, e % 65536 + e * 7919 % 65536 + 65535 AS s FROM packets)", "SELECT e, sha256(js) AS sha256, CASE WHEN crc = 0 THEN 1 ELSE crc END AS nonzero_crc, (65535 - (((s & 65535) + (s >> 16)) & 65535) - (((s & 65535) + (s >> 16)) >> 16))::BIGINT AS ones FROM c JOIN w USING (e)"),
    "header_axis": sql("packets", "SELECT e, magic, version, header_bytes, board_id, stream_type, sample0, frame_id, seq_no, chan0, chan_count, time_count, product_id, block_index, spec_status_flags, 1311768467294899695 - e AS sync_generation, -e AS observation_tag, 39612 AS mts_id FROM packets"),
    "header_axis_native": sql("packets", "SELECT e, magic, version, seq_no, sample0, chan0, spec_status_flags, -e AS observation_tag FROM packets"),
    "axis_words": sql("packets", "SELECT e, array_to_string(list_transform(range(CASE WHEN e % 4 = 0 THEN 2 ELSE 3 END), lambda w: array_to_string(list_transform(list_filter(range(8), lambda b: ((e * (2 * w + 3) % 256) >> b) & 1 = 1), lambda b: upper(lpad(to_hex((([e * 4328719365, -e, e + 7][w + 1] >> (8 * b)) & 255)::UTINYINT), 2, '0'))), '')), '') AS bytes FROM packets"),
    "dac_witness": sql("captures", "SELECT capture, n AS sample, (n % 4)::INTEGER AS lane, (((i + 32768) & 65535) - 32768)::INTEGER AS i, (((q + 32768) & 65535) - 32768)::INTEGER AS q FROM captures"),
    "header_packed": sql("packets", "SELECT e, CASE WHEN chan0 = 0 THEN e % 7 ELSE chan0 END AS chan0_native, CASE WHEN version >= 3 THEN 1311768467294899695 - e END AS sync_native, magic, version, seq_no, sample0, CASE WHEN chan0 = 0 THEN e % 7 ELSE chan0 END AS chan0, payload_bytes, CASE WHEN version >= 3 THEN 1311768467294899695 - e END AS sync_generation, CASE WHEN version >= 3 THEN 39612 END AS mts_id FROM packets"),
    "frame_parse": sql("packets", """SELECT e, fast_error, strict_error, CASE WHEN fast_error IS NULL THEN '10.0.1.1' END AS src_ip, CASE WHEN fast_error IS NULL THEN '08:c0:eb:d5:95:b2' END AS dst_mac, CASE WHEN fast_error IS NULL THEN dst_port END AS dst_port, CASE WHEN fast_error IS NULL THEN lpad(to_hex(e), 16, '0') END AS payload FROM (
        SELECT e, dst_port, CASE WHEN e % 13 = 0 THEN 'FrameTooShort' WHEN e % 17 = 0 THEN 'NonIpv4Ethernet' WHEN dst_port >= 4320 THEN 'WrongUdpDstPort' WHEN e % 19 <> 0 AND e % 23 = 0 THEN 'BadUdpLength' END AS fast_error,
        CASE WHEN e % 13 = 0 THEN 'FrameTooShort' WHEN e % 17 = 0 THEN 'NonIpv4Ethernet' WHEN e % 19 = 0 THEN 'UnsupportedIpv4Header' WHEN e % 23 = 0 THEN 'BadUdpLength' END AS strict_error FROM packets)"""),
    "time_decode": sql("packets", _TIME),
    "time_decode_native": sql("packets", _TIME),
    "spec_decode": sql("packets", "SELECT e, (k // 32)::INTEGER AS t, count(*) AS cells, sum(k * (block_index::BIGINT + k // 8 % 4))::BIGINT AS i_by_chan, sum(-k * (k % 8))::BIGINT AS q_by_input FROM packets, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2"),
    "packetise": sql("samples", "SELECT n // 16 AS frame_id, min(n) AS sample0, 512::INTEGER AS bytes, arg_min(i, n * 8 + channel) AS first_i, arg_max(q, n * 8 + channel) AS last_q FROM samples GROUP BY 1 HAVING count(*) = 128"),
    "witness_decode": sql("captures", "SELECT capture, n // 4 AS beat, (((i + 32768) & 65535) - 32768)::INTEGER AS i, (((q + 32768) & 65535) - 32768)::INTEGER AS q FROM captures WHERE n % 4 = 2"),
    "metadata_fallback": sql("packets", "SELECT e, CASE WHEN e % 2 = 1 AND e % 3 > 0 THEN e + 1 ELSE -e END AS seq, coalesce(nullif(e % 5, 0), e % 11) AS count, CASE WHEN e % 4 = 0 THEN 'named' WHEN e % 3 = 1 THEN '100' WHEN e % 3 = 2 THEN '200' ELSE 'unknown' END AS profile FROM packets"),
}


def _spec_packets() -> str:
    from fluxframe.operators.dsp import SQL as other

    half = lambda v: f"substr(lpad(to_hex({v} & 65535), 4, '0'), 3, 2) || substr(lpad(to_hex({v} & 65535), 4, '0'), 1, 2)"
    return f"""WITH f AS ({other['pfb4_sum']}) SELECT 3::BIGINT AS version, (frame - 3) * 16 AS sample0, frame * 4 + phase // 4 AS frame_id, frame * 4 + phase // 4 AS seq_no, (phase // 4 * 4)::BIGINT AS chan0, (phase // 4)::BIGINT AS block_index, 4::BIGINT AS block_count, (phase >= 8)::BIGINT AS spec_half_band,
        upper(string_agg({half('i')} || {half('q')}, '' ORDER BY phase, channel)) AS payload FROM f GROUP BY frame, phase // 4, phase >= 8 HAVING count(*) = 32"""


SQL["spec_packetise"] = _spec_packets()
