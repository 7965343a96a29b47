"""Capture files read in byte ranges: every packet once, whatever the ranges and the bytes of the payloads."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from fluxframe.sources import captures


T0 = 1_700_000_000


def frame(payload, port=4300):
    ip = bytes([0x45, 0]) + struct.pack(">H", 28 + len(payload)) + bytes(5) + bytes([17]) + bytes(10)
    return bytes(12) + b"\x08\0" + ip + struct.pack(">HHHH", 4000, port, 8 + len(payload), 0) + payload


def payload_of(rng, k):
    """Random bytes, zeros, and bytes that look like records of another capture."""
    kind = rng.randrange(4)
    size = rng.choice([0, 8, 200, 1500, 9000])
    if kind == 0:
        return rng.randbytes(size)
    if kind == 1:
        return bytes(size)
    if kind == 2:
        return b"".join(captures.PACKET_HEAD.pack(T0 + k, 5, 40, 40) + rng.randbytes(40) for _ in range(size // 56)) + b"tail!"
    return struct.pack("<I", 1000) * (size // 4) + b"end"


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    rng = random.Random(4)
    packets = [(T0 + k / 64, frame(payload_of(rng, k), 4298 + k % 7)) for k in range(1200)]
    path = tmp_path_factory.mktemp("pcap") / "one.pcap"
    captures.write_pcap(str(path), packets)
    return path, packets


@pytest.mark.parametrize("step", [1, 4999, 30_000, 1 << 16, 1 << 20, 1 << 30])
def test_ranges_make_the_file(capture, step):
    path, packets = capture
    size = path.stat().st_size
    got = []
    with captures.fs.LocalFileSystem().open_input_file(str(path)) as f:
        for lo in range(0, size, step) if step > 1 else range(0, 400):
            hi = size if step == 1 and lo == 399 else min(lo + step, size)
            got += captures.records(f, size, lo, hi)
    assert [p[2] for p in got] == [f for _, f in packets]
    assert [p[1] for p in got] == [int(t * 1e6) for t, _ in packets]


def test_uncertain_border_raises(tmp_path):
    """Records within a payload that end where it ends can't be told from the file's own: that is said, and nothing is read twice."""
    inner = b"".join(captures.PACKET_HEAD.pack(1000, 0, 84, 84) + bytes(84) for _ in range(80))
    path = tmp_path / "odd.pcap"
    captures.write_pcap(str(path), [(1000, frame(bytes(100))), *((1000, frame(inner)) for _ in range(20))])
    size = path.stat().st_size
    with captures.fs.LocalFileSystem().open_input_file(str(path)) as f:
        with pytest.raises(ValueError, match="split_bytes 0"):
            list(captures.records(f, size, 0, 4000))
        assert len(list(captures.records(f, size, 0, size))) == 21


def test_truncated_and_empty_files(tmp_path):
    path = tmp_path / "a.pcap"
    captures.write_pcap(str(path), [(5, frame(bytes(100))) for _ in range(30)])
    whole = path.read_bytes()
    for cut, left in ((len(whole) - 1, 29), (len(whole) - 142, 29), (24, 0), (30, 0), (len(whole), 30)):
        path.write_bytes(whole[:cut])
        with captures.fs.LocalFileSystem().open_input_file(str(path)) as f:
            assert sum(len(list(captures.records(f, cut, lo, min(lo + 500, cut)))) for lo in range(0, cut, 500)) == left


def test_one_file_is_many_tasks_with_pushed_filters(spark, capture):
    path, packets = capture
    df = captures.frames(spark, str(path.parent), base_port=4299, port_count=6, split_bytes=200_000)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // 200_000) > 5
    want = [f for t, f in packets if f[36:38] in (struct.pack(">H", p) for p in range(4299, 4305))]
    assert sorted(bytes(r.frame) for r in df.collect()) == sorted(want)
    some = df.filter((F.col("dst_port") == 4301) & (F.col("ts") >= F.lit("2023-11-14 22:13:25").cast("timestamp")) & (F.length("frame") > 0))
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("Filter", 1)[1].split("BatchScan")[0] if "Filter" in plan.split("BatchScan")[0] else ""
    assert "dst_port" not in kept and "length(frame" in kept  # the port and the time are tested while records are walked
    assert sorted(bytes(r.frame) for r in some.collect()) == sorted(f for t, f in packets if f[36:38] == struct.pack(">H", 4301) and t >= T0 + 5)
    assert df.filter(F.col("dst_port").isin(4300, 4302)).count() == sum(f[36:38] in (struct.pack(">H", 4300), struct.pack(">H", 4302)) for _, f in packets)


def test_stream_equals_table(spark, capture, tmp_path):
    path, _ = capture
    q = captures.frames(spark, str(path.parent), stream=True, split_bytes=300_000).writeStream.format("memory").queryName("ranges").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.file, r.number, r.ts, r.dst_port, bytes(r.frame)) for r in df.collect())
    assert key(spark.table("ranges")) == key(captures.frames(spark, str(path.parent)))


def test_written_and_read(spark, tmp_path):
    df = spark.range(5000).repartition(3).select(F.timestamp_micros(F.col("id") * 1001 + 1_000_000).alias("ts"), F.encode(F.concat(F.lit("x" * 60), F.col("id").cast("string")), "UTF-8").alias("frame"))
    assert captures.write_captures(df, f"file://{tmp_path}/out") == 5000
    got = captures.frames(spark, f"file://{tmp_path}/out", "udp_payload", split_bytes=50_000)
    assert sorted((r.ts, bytes(r.frame)) for r in got.collect()) == sorted((r.ts, bytes(r.frame)) for r in df.collect())
