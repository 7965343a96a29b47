"""Capture files as tables and streams, and the other inputs and outputs of the receiver.

A capture file is a classic pcap file of Ethernet frames (kind "frame") or of bare UDP payloads (kind "udp_payload", whose
port is that of base_port). A file is cut into ranges of split_bytes, and each range is a task: it begins at the first record
that starts in it, and ends with the last. Files have no marks between records, so a range looks for a place from which
records follow each other for longer than any packet; where a range ends, it knows the border exactly, and it raises if the
search of the next range would find another. So a file is read whole and once, or not at all: split_bytes of 0 then reads files in one task each.

CaptureSource is Spark's data source "pcap" of a table; filters on dst_port and ts are pushed into it and run while records are
walked, so refused packets never become rows. A stream lists files by Spark's own file source, which keeps in its checkpoint
which ones it has taken, whatever their names and the order in which they come, and reads their ranges in the same way.
Files are read through pyarrow's file systems (local, HDFS, S3, GCS) by tasks; the driver only lists them.
"""

from __future__ import annotations

import io
import operator
import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

#: number: the byte of the file at which the packet's record starts.
FRAMES = T.StructType().add("file", T.StringType()).add("number", T.LongType()).add("ts", T.TimestampType()).add("dst_port", T.IntegerType()).add("frame", T.BinaryType())
PCAP_HEAD, PACKET_HEAD = struct.Struct("<IHHiIII"), struct.Struct("<IIII")
PCAP_MAGIC = 0xA1B2C3D4
SPLIT = 64 << 20
#: The most bytes of a packet, and of its record, and how far times may lie from the file's first.
MOST_BYTES, YEAR = 65535, 366 * 86400
REACH = PACKET_HEAD.size + MOST_BYTES


def file_head() -> bytes:
    return PCAP_HEAD.pack(PCAP_MAGIC, 2, 4, 0, 0, MOST_BYTES, 1)


def record_of(us: int, frame: bytes) -> bytes:
    return PACKET_HEAD.pack(us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame


def write_pcap(path: str, frames: list[tuple[float, bytes]]) -> None:
    """Frames with their times in seconds; the file appears under its name when it is whole."""
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(file_head())
        for ts, frame in frames:
            f.write(record_of(int(ts * 1e6), frame))
    os.replace(part, path)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in spark.checkpoint.dir, which all machines share; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='fluxframe-')}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_captures(df: DataFrame, path: str) -> int:
    """Frames (ts, frame) as pcap files under path, one a task, in the rows' order; how many. A task that is run again writes
    its file anew, and a file appears under its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        store.create_dir(folder)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        part, n = f"{name}.{TaskContext.get().taskAttemptId()}", 0
        with store.open_output_stream(part) as f:
            f.write(file_head())
            for batch in batches:
                for us, frame in zip(batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist(), batch.column("frame").to_pylist(), strict=True):
                    f.write(record_of(us, frame))
                    n += 1
        store.move(part, f"{name}.pcap")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.select(F.col("ts").cast("timestamp").alias("ts"), "frame").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _is_record(data: bytes, at: int, first_second: int) -> int:
    """The length of what looks like a record there, or 0."""
    sec, us, size, whole = PACKET_HEAD.unpack_from(data, at)
    return PACKET_HEAD.size + size if us < 1_000_000 and 0 < size <= MOST_BYTES and size <= whole <= 1 << 20 and abs(sec - first_second) <= YEAR else 0


def find_border(f: pa.NativeFile, size: int, at: int, first_second: int) -> int:
    """The first place from at on from which records follow each other for longer than any packet, or up to the end; size if
    there is none."""
    f.seek(at)
    data = f.read(min(size - at, 3 * REACH))
    ends = at + len(data) == size
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24 if len(raw) > PACKET_HEAD.size else raw[:0]
    n = max(0, min(REACH, len(words) - 12))
    likely = (words[4 : n + 4] < 1_000_000) & (words[8 : n + 8] <= words[12 : n + 12]) & (words[8 : n + 8] <= MOST_BYTES) & (words[8 : n + 8] > 0)
    for start in np.flatnonzero(likely).tolist():
        place, steps = start, 0
        while place <= start + REACH and place + PACKET_HEAD.size <= len(data) and (step := _is_record(data, place, first_second)):
            place, steps = place + step, steps + 1
        if place > start + REACH and steps > 1 or ends and (place == len(data) or steps > 1 and place + PACKET_HEAD.size > len(data)):
            return at + start
    return size


def _cut_off(f: pa.NativeFile, size: int, at: int) -> bool:
    """Whether no whole record starts there, as the file ends."""
    f.seek(at)
    head = f.read(PACKET_HEAD.size)
    return len(head) < PACKET_HEAD.size or at + PACKET_HEAD.size + PACKET_HEAD.unpack(head)[2] > size


def records(f: pa.NativeFile, size: int, lo: int, hi: int, name: str = "") -> Iterator[tuple[int, int, bytes]]:
    """Place, time in microseconds and bytes of each packet whose record starts in lo to hi; a packet cut off at the end of the
    file isn't given."""
    f.seek(0)
    head = f.read(PCAP_HEAD.size + PACKET_HEAD.size)
    if len(head) < PCAP_HEAD.size or PCAP_HEAD.unpack_from(head)[0] != PCAP_MAGIC:
        raise ValueError(f"not a little-endian pcap file: {name}")
    if len(head) < PCAP_HEAD.size + PACKET_HEAD.size:
        return
    (second,) = struct.unpack_from("<I", head, PCAP_HEAD.size)
    at = PCAP_HEAD.size if lo <= PCAP_HEAD.size else find_border(f, size, lo, second)
    f.seek(at)
    data, base = b"", at
    while at < hi:
        if at - base + PACKET_HEAD.size > len(data):
            data, base = data[at - base :] + f.read(1 << 20), at
            if len(data) < PACKET_HEAD.size:
                return
        sec, us, length, _ = PACKET_HEAD.unpack_from(data, at - base)
        start = at - base + PACKET_HEAD.size
        if start + length > len(data):
            data, base, start = data[at - base :] + f.read(max(length, 1 << 20)), at, PACKET_HEAD.size
            if start + length > len(data):
                return
        yield at, sec * 1_000_000 + us, data[start : start + length]
        at += PACKET_HEAD.size + length
    if hi < size and not _cut_off(f, size, at) and find_border(f, size, hi, second) != at:
        raise ValueError(f"{name}: the record border at byte {at} isn't certain from there; read this capture with split_bytes 0")


Kept = Callable[[int, int], bool]


def read_range(path: str, size: int, lo: int, hi: int, kind: str, base_port: int, port_count: int, kept: Kept = lambda port, us: True) -> Iterator[pa.RecordBatch]:
    """FRAMES of a range of a file whose port is in range and that are kept by port and time."""
    arrow = to_arrow_schema(FRAMES)
    columns: list[list] = [[], [], [], [], []]
    name = os.path.basename(path)

    def port_of(frame: bytes) -> int:
        if kind == "udp_payload":
            return base_port
        if len(frame) < 42 or frame[12:14] != b"\x08\0" or frame[23] != 17:
            return -1
        return int.from_bytes(frame[14 + (frame[14] & 15) * 4 + 2 :][:2], "big")

    def full() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(columns, arrow, strict=True)], schema=arrow)
        for c in columns:
            c.clear()
        return out

    store, place = store_of(path)
    with store.open_input_file(place) as f:
        for at, us, frame in records(f, size, lo, hi, path):
            port = port_of(frame)
            if base_port <= port < base_port + port_count and kept(port, us):
                for c, v in zip(columns, (name, at, us, port, frame), strict=True):
                    c.append(v)
                if len(columns[0]) == 1024:
                    yield full()
    if columns[0]:
        yield full()


class Range(InputPartition):
    def __init__(self, path: str, size: int, lo: int, hi: int) -> None:
        self.path, self.size, self.lo, self.hi = path, size, lo, hi


TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "frame")
        self.ports = int(options.get("base_port", 4300)), int(options.get("port_count", 24))
        self.split = int(options.get("split_bytes", SPLIT))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of dst_port and ts are taken, and that columns aren't null, as none is; Spark keeps the rest."""
        micros = lambda t: round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1e6) if isinstance(t, datetime) else None
        for x in filters:
            value = getattr(x, "value", None)
            if type(x) in TESTS and x.attribute == ("dst_port",):
                self.tests.append(("port", type(x), value))
            elif type(x) in TESTS and type(x) is not In and x.attribute == ("ts",) and micros(value) is not None:
                self.tests.append(("us", type(x), micros(value)))
            elif not isinstance(x, IsNotNull):
                yield x

    def partitions(self) -> list[Range]:
        store, folder = store_of(self.path)
        found = store.get_file_info(folder)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(folder, recursive=True))
        out, prefix = [], self.path.split("://")[0] + "://" if "://" in self.path else ""
        for info in files:
            if info.is_file and info.path.endswith(".pcap"):
                step = self.split or max(info.size, 1)
                out += [Range(prefix + info.path, info.size, lo, min(lo + step, info.size)) for lo in range(0, info.size, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        tests = [(of, TESTS[how], value) for of, how, value in self.tests]
        kept = lambda port, us: all(test(port if of == "port" else us, value) for of, test, value in tests)
        return read_range(part.path, part.size, part.lo, part.hi, self.kind, *self.ports, kept)


class CaptureSource(DataSource):
    """Options: path (a file, or a folder of .pcap files), kind, base_port, port_count, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> T.StructType:
        return FRAMES

    def reader(self, schema: T.StructType) -> CaptureReader:
        return CaptureReader(self.options)


def frames(spark: SparkSession, path: str, kind: str = "frame", base_port: int = 4300, port_count: int = 24, stream: bool = False, files_per_trigger: int = 64, split_bytes: int = SPLIT) -> DataFrame:
    """Packets of the .pcap files under path whose port is in range, as FRAMES; with stream, of files as they arrive. As a table
    it takes filters on dst_port and ts down (the session setting spark.sql.python.filterPushdown.enabled is turned on)."""
    if kind not in ("frame", "udp_payload"):
        raise ValueError(f"kind {kind}")
    if not stream:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(CaptureSource)
        return spark.read.format("pcap").options(path=path, kind=kind, base_port=base_port, port_count=port_count, split_bytes=split_bytes).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "lo", "hi")), strict=True):
                yield from read_range(name, size, lo, hi, kind, base_port, port_count)

    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.pcap").option("maxFilesPerTrigger", files_per_trigger).load(path)
    step = F.lit(split_bytes) if split_bytes else F.greatest(F.col("length"), F.lit(1))
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long"))).alias("lo")).withColumn("hi", F.least(F.col("lo") + step, F.col("length")))
    return ranges.repartition("path", "lo").mapInArrow(run, FRAMES)


def numpy_captures(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Complex samples of .npy and .npz files: file, n, re, im. Real arrays hold pairs in their last dimension of 2; of an
    .npz file the array `key` is read, or its only one. Files are read by Spark, so any store that it reads will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                x = np.load(io.BytesIO(data), allow_pickle=False)
                if isinstance(x, np.lib.npyio.NpzFile):
                    x = x[key or x.files[0]]
                if not np.iscomplexobj(x):
                    if not x.ndim or x.shape[-1] != 2:
                        raise ValueError(f"{name}: complex values or a last dimension of 2 are needed")
                    x = x[..., 0] + 1j * x[..., 1]
                x = x.reshape(-1)
                for lo in range(0, len(x), 1 << 16):
                    part = x[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)] * len(part), pa.string()), pa.array(np.arange(lo, lo + len(part))), pa.array(part.real.astype(float)), pa.array(part.imag.astype(float))], names=["file", "n", "re", "im"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, n long, re double, im double")


def packet_files(spark: SparkSession, path: str) -> DataFrame:
    """One packet a file, as bytes: file, packet."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("packet"))


def synthetic_tone(spark: SparkSession, count: int, mask: int, sample0: int, rate_hz: float, center_hz: float, signal_hz: float, amplitude: float = 2048, phase_deg: float = 0, phase_step_deg: float = 0, noise: float = 0, seed: int = 1) -> DataFrame:
    """n, channel, i, q of a tone at signal_hz seen from center_hz, rounded half to even and clipped to 16 bits; noise is
    Gaussian with that deviation, seeded by sample and channel."""
    turn = F.pmod((F.col("id") + sample0) * ((signal_hz - center_hz) / rate_hz), F.lit(1.0)) * 360 + phase_deg + F.col("channel") * phase_step_deg
    df = spark.range(count).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in range(8) if mask >> c & 1])))
    clip = lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.rint(x))).cast("int")
    normal = lambda k: F.lit(0.0) if not noise else noise * F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), "id", "channel"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30)))) * (F.cos if k == 0 else F.sin)(2 * np.pi * F.pmod(F.xxhash64(F.lit(seed + 1), "id", "channel"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return df.select(F.col("id").alias("n"), "channel", clip(amplitude * F.cos(F.radians(turn)) + normal(0)).alias("i"), clip(amplitude * F.sin(F.radians(turn)) + normal(1)).alias("q"))


COUNTERS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("board_id", T.IntegerType()), T.StructField("counters", T.MapType(T.StringType(), T.LongType()))])


def counter_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots as JSON lines {ts, board_id, counters: {name: value}}, in long form."""
    return spark.read.schema(COUNTERS).json(path).select("ts", "board_id", F.explode("counters").alias("name", "value"))


def ethtool_counters(df: DataFrame, text: str = "text") -> DataFrame:
    """Counters from the text of `ethtool -S`: df's other columns, name, value."""
    line = F.explode(F.expr(f"regexp_extract_all({text}, '([A-Za-z0-9_.]+): ([0-9]+)', 0)"))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, line.alias("l")).select(*rest, F.split("l", ": ")[0].alias("name"), F.split("l", ": ")[1].cast("long").alias("value"))


# The display formats, little-endian.
WAVEFORM = struct.Struct("<4sHHQIIIIIIIIII10d")
WAVEFORM_MAGIC, WAVEFORM_VERSION, WAVEFORM_BYTES = b"TFW5", 5, 160
WAVEFORM_ARRAYS = ("x_us", "i", "q", "mag", "sample_rf")
SPECTRUM = struct.Struct("<4sHHQQ20IQQ")
SPECTRUM_MAGIC, SPECTRUM_VERSION, SPECTRUM_BYTES = b"TSP3", 2, 128
SPECTRUM_WORDS = ("seq_no", "gap_before", "chan0", "chan_count", "time_count", "ninput", "src_port", "dst_port", "lanes", "bins", "product_id", "nchan", "block_index", "block_count", "pfb_taps", "fft_shift", "spec_status_flags", "spec_sample_rate_hz", "coverage_blocks", "reserved")


def waveform_bytes(w: dict) -> bytes:
    """A waveform snapshot: its header and each channel's float arrays, cut to the shortest channel."""
    channels = w["channels"]
    points = min((min(len(c[a]) for a in WAVEFORM_ARRAYS) for c in channels), default=0)
    curve = min((min(len(c["rf_x_us"]), len(c["rf"])) for c in channels), default=0)
    detected = w.get("detected_mhz") or 0
    flags = int(w["gap_before"]) | int(bool(detected) and detected != w["selected_mhz"]) << 1
    numbers = [w[n] for n in ("sample_rate_hz", "window_us", "center_mhz", "expected_mhz", "dac_mhz", "expected_baseband_mhz", "rf_samples_per_cycle", "baseband_samples_per_cycle", "rf_window_cycles", "captured_window_us")]
    head = WAVEFORM.pack(WAVEFORM_MAGIC, WAVEFORM_VERSION, WAVEFORM_BYTES, w["sample0"], w["seq_no"], w["seq_end"], w["selected_mhz"], detected, flags, sum(1 << c["channel"] for c in channels), points, len(channels), w["decimation"], curve, *numbers)
    body = [np.asarray(c[a][:points], "<f4").tobytes() for c in channels for a in WAVEFORM_ARRAYS]
    order = [body[5 * k + j] if j < 5 else np.asarray(c[("rf_x_us", "rf")[j - 5]][:curve], "<f4").tobytes() for k, c in enumerate(channels) for j in range(7)]
    return head.ljust(WAVEFORM_BYTES, b"\0") + b"".join(order)


def spectrum_bytes(s: dict) -> bytes:
    lanes = s["lanes"]
    bins = min((min(len(x[a]) for a in ("amplitude", "phase_rad", "power_db")) for x in lanes), default=0)
    own = {"lanes": len(lanes), "bins": bins, "reserved": 0}
    words = {n: own[n] if n in own else int(s.get(n) or 0) for n in SPECTRUM_WORDS}
    head = SPECTRUM.pack(SPECTRUM_MAGIC, SPECTRUM_VERSION, SPECTRUM_BYTES, s["sample0"], s["frame_id"], *[words[n] for n in SPECTRUM_WORDS], s.get("coverage_lo", 0), s.get("coverage_hi", 0))
    return head.ljust(SPECTRUM_BYTES, b"\0") + b"".join(np.asarray(x[a][:bins], "<f4").tobytes() for x in lanes for a in ("amplitude", "phase_rad", "power_db"))


def to_binary(df: DataFrame, kind: str, to: str = "message") -> DataFrame:
    """Snapshots (one a row, channels or lanes as arrays of structs) with their message in the display format."""
    make = {"waveform": waveform_bytes, "spectrum": spectrum_bytes}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([make(r) for r in batch.to_pylist()], pa.binary())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def to_json_lines(df: DataFrame, path: str) -> None:
    """Gate results as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def latest_state(batch: DataFrame, epoch: int, path: str) -> None:
    """For foreachBatch: the state of this trigger replaces the one before."""
    batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").json(path)
