"""Known values of single operators, and streams against batches."""

import hashlib
import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.functions import bits, signal
from fluxframe.operators import analysis, codec, config, dsp, flows, gates, receiver, routes, spectrum, validate
from fluxframe.plans.views import packets
from fluxframe.sources import captures
from fluxframe.streaming.receiver import Arbiter, Assembler, Capture, PreviewGate, Reorder, Ring, Steps, before, first_blocks, run_batch, run_stream, windowed_rates


def packet(seq, **more):
    return {"seq_no": seq % 2**32, "frame_id": seq, "sample0": 10_000 + 256 * seq, "time_count": 64} | more


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_time_payload(spark):
    df = spark.createDataFrame([(1000, 64, 0, 2)], "sample0 long, time_count int, seq_no int, version int")
    out = codec.explode_time(codec.build_packets(df, 64).select("sample0", "time_count", "packet"), 2, [3]).orderBy("sample_index").collect()
    assert [tuple(r) for r in out[:2]] == [(1000, 3, 3, -3), (1002, 3, 13, -13)]
    assert tuple(out[4]) == (1008, 3, 103, -103)
    assert len(out) == 256


def test_truncated_payload_is_refused(spark):
    df = codec.build_packets(spark.createDataFrame([(0, 64)], "sample0 long, time_count int"), 2)
    assert codec.explode_time(df.select("sample0", "time_count", "packet")).count() == 0


def test_udtf(spark):
    codec.register(spark)
    codec.build_packets(spark.createDataFrame([(7, 4)], "sample0 long, time_count int")).createOrReplaceTempView("p")
    assert spark.sql("SELECT sum(i) AS s, count(*) AS n FROM p, LATERAL time_payload(packet, time_count)").first().n == 128


def test_version_3_words(spark):
    row = {"version": 3, "header_bytes": 128, "magic": validate.MAGIC, "sync_generation": 0x31, "observation_tag": 0x1234, "signal_chain_tag": 0x5678, "mts_id": 0x9ABC}
    for layout, decode in (("axis", codec.decode_axis), ("packed", codec.decode_packed)):
        df = codec.encode_headers(spark.createDataFrame([row]), layout)
        h = df.select(decode(F.col("header")).alias("h")).first().h
        assert {k: h[k] for k in row} == row
        again = codec.decode_headers(df.select(F.col("header").alias("packet")), layout=layout).first()
        assert {k: again[k] for k in row} == row
        short = codec.decode_headers(df.select(F.substring("header", 1, 127).alias("packet")), layout=layout).first()
        assert set(short) == {None}
    words, keep = F.array(F.lit(0x0102030405060708), F.lit(0x1112131415161718)), F.array(*map(F.lit, (0xFF, 0x03, 0xFF)))
    assert bytes(values(spark, codec.beats_to_bytes(words, keep))[0]) == bytes([8, 7, 6, 5, 4, 3, 2, 1, 0x18, 0x17])


def framed(spark, *rows):
    df = spark.createDataFrame([(n, bytes(p), s, d) for n, (p, s, d) in enumerate(rows)], "n int, payload binary, src_port int, dst_port int")
    return [bytes(r.frame) for r in codec.encode_frames(df).orderBy("n").collect()]


def test_strict_and_fast_frames(spark):
    good, empty = framed(spark, (b"abc", 4000, 4301), (b"", 1, 4301))
    bad_sum = good[:24] + b"\0\0" + good[26:]
    rows = spark.createDataFrame([(good,), (bad_sum,), (good[:30],), (empty,)], "f binary")
    out = rows.select(codec.parse_frame(F.col("f"), 4300, 2).alias("fast"), codec.parse_frame(F.col("f"), 4300, 1).alias("narrow"), codec.parse_frame(F.col("f"), strict=True).alias("strict")).collect()
    assert [r.fast.error for r in out] == [None, None, "FrameTooShort", None]
    assert [r.narrow.error for r in out] == ["WrongUdpDstPort", "WrongUdpDstPort", "FrameTooShort", "WrongUdpDstPort"]
    assert [r.strict.error for r in out] == [None, "UnsupportedIpv4Header", "FrameTooShort", None]
    assert bytes(out[0].fast.payload) == b"abc" and out[0].fast.dst_mac == "08:c0:eb:d5:95:b2"


def test_numbers(spark):
    r = lambda x: bits.round_half_away(F.lit(x), 17)
    assert values(spark, r(65536), r(-65536), r(65535), r(-196608)) == [1, -1, 0, -2]
    assert values(spark, bits.s16(F.lit(40000)), bits.saturate(F.lit(-40000), 16), bits.delta_mod(F.lit(3), F.lit(2**32 - 2)), bits.signed_distance(F.lit(0), F.lit(2**32 - 1))) == [-25536, -32768, 5, 1]
    assert values(spark, bits.delta_mod(F.lit(-(2**63)), F.lit(2**63 - 1), 64), bits.u64_decimal(F.lit(-1)).cast("string")) == [1, str(2**64 - 1)]
    w = signal.wrap_degrees
    assert values(spark, w(F.lit(-180.0)), w(F.lit(180.0)), w(F.lit(540.0)), w(F.lit(-190.0))) == [180, 180, 180, 170]
    assert values(spark, *[signal.infer_bandwidth(F.lit(d), F.lit(64)) for d in (256, 512, 2048, 123)]) == [200, 100, 20, None]
    assert values(spark, signal.samples_per_cycle(F.lit(1e6), F.lit(0.5)), signal.bandwidth_mhz(F.lit("100 MHz")), signal.bandwidth_mhz(F.lit("7"))) == [math.inf, 100, None]


def test_filters(spark):
    assert sum(dsp.pfb_coefficients()) == 536_870_912 and len(dsp.pfb_coefficients()) == 16384
    assert dsp.HALF_BAND[0] + 2 * sum(v for k, v in dsp.HALF_BAND.items() if k) == 131072
    rng = np.random.default_rng(1)
    x = rng.integers(-32768, 32768, (200, 2))
    df = spark.createDataFrame([(int(n), 0, int(a), int(b)) for n, (a, b) in enumerate(x)], "n long, channel int, i int, q int")
    got = {r.n: (r.i, r.q) for r in dsp.half_band(df).collect()}
    taps = np.array([dsp.HALF_BAND.get(abs(k), 0) for k in range(-20, 21)])
    for n in range(20, 180, 2):
        acc = (x[n - 20 : n + 21] * taps[:, None]).sum(0)
        want = np.clip(np.sign(acc) * ((np.abs(acc) + 65536) >> 17), -32768, 32767)
        assert got[n] == tuple(want)
    assert min(got) == 20
    constant = df.withColumns({"i": F.lit(-32768), "q": F.lit(32767)})
    assert {(r.i, r.q) for r in dsp.half_band(constant).collect()} == {(-32768, 32767)}


def test_monitor_extremes(spark):
    df = spark.createDataFrame([(0, 0, -32768, 32767)], "n long, channel int, i int, q int")
    assert tuple(dsp.monitor(df).first()) == (0, 1, 1, 65535)
    assert spectrum.channel_statistics(df).first().peak == 32767


def test_ties(spark):
    df = spark.createDataFrame([(b, p) for b, p in enumerate([1, 9, 3, 9, 1])], "bin int, power long").withColumn("k", F.lit(0))
    assert spectrum.noise_floor(df, "k", 0).first().peak_bin == 1
    assert dsp.peak_cells(df.select("bin", F.col("power").alias("i"), F.lit(0).alias("q"))).first().bin == 3


@pytest.mark.parametrize("order, window, expect", [((0, 2, 1), 8, (0, 0, 0, 0, 2, 200)), ((0, 4), 2, (1, 1, 1, 4, 4, None))])
def test_reorder(order, window, expect):
    machine = Reorder(window, 200)
    for s in order:
        machine.feed(packet(s))
    s = machine.summary()
    got = (s["seq_gaps"], s["frame_gaps"], s["sample0_gaps"], s["app_drops"], s["last_seq"], s["detected_mhz"])
    assert got[:3] == expect[:3] and got[3] >= min(3, expect[3]) and got[4:] == expect[4:]


def test_reorder_wraps():
    machine = Reorder(8, 200)
    out = [p["seq_no"] for s in (2**32 - 2, 2**32, 2**32 - 1, 2**32 + 1) for p in machine.feed(packet(s))]
    assert out == [2**32 - 2, 2**32 - 1, 0, 1] and machine.summary()["seq_gaps"] == 0
    assert before(2**32 - 1, 0) and not before(0, 2**32 - 1)


BLOCK = {"product_id": 0xF101, "nchan": 8, "pfb_taps": 4}


def test_assembler():
    """A group counts once its last block is there; another group starts afresh; blocks land at their first channel."""
    machine, out = Assembler(), []
    lane = lambda v: [{"input": 1, "amplitude": [v, v + 1], "phase_rad": [0.0] * 2, "power_db": [v] * 2}]
    for frame, block, v in ((29, 1, 1.0), (32, 0, 2.0), (33, 1, 4.0), (34, 2, 6.0), (35, 3, 8.0), (35, 3, 8.0), (35, 4, 9.0)):
        out += machine.feed(BLOCK | {"frame_id": frame, "block_index": block, "block_count": 4, "chan0": 2 * block, "chan_count": 2, "lanes": lane(v)})
    assert [(r["frame_group"], r["coverage"], r["mask_lo"], r["mask_hi"]) for r in out] == [(8, 4, 15, 0)]
    assert out[0]["lanes"]["1"]["amplitude"] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    assert machine.summary() == {"published": 1, "dropped": 1, "refused": 1}


@pytest.mark.parametrize("blocks", [64, 128])
def test_assembler_of_many_blocks(blocks):
    machine = Assembler()
    out = [r for k in range(blocks) for r in machine.feed(BLOCK | {"frame_id": k, "block_index": k, "block_count": blocks})]
    assert [(r["mask_lo"], r["mask_hi"], r["coverage"]) for r in out] == [(-1, -1 if blocks == 128 else 0, blocks)]


def test_assembler_interval():
    machine = Assembler(100)
    feed = lambda k, t: machine.feed(BLOCK | {"frame_id": 4 + k, "block_index": k, "block_count": 2, "t_ms": t})
    assert [len(feed(k, t)) for k, t in ((0, 0), (1, 10), (1, 50), (0, 110), (1, 150), (1, 230))] == [0, 1, 0, 1, 0, 1]


def test_capture():
    """Missing packets are waited for; a full hold gives what is there up to the hole."""
    machine = Capture(3, 2, 5)
    feed = lambda *seqs: [r for s in seqs for r in machine.feed({"seq_no": s})]
    assert feed(0, 4, 1, 2) == [{"first": 0, "last": 4, "packets": 3}]
    assert feed(6, 5, 10, 11, 12, 13) == [{"first": 6, "last": 6, "packets": 1}]


def test_preview_gate():
    """A group ahead is taken block by block; then the next is chosen, after the interval and the timeout."""
    gate_ = PreviewGate(2, 100, 500)
    feed = lambda frame, t: [r["frame_group"] for r in gate_.feed({"frame_id": frame, "block_index": frame % 4, "block_count": 4, "seq_no": frame, "t_ms": t})]
    assert [feed(*x) for x in ((0, 0), (4, 10), (8, 20), (8, 21), (9, 22), (12, 400), (16, 530), (24, 540), (25, 541))] == [[], [], [2], [], [2], [], [], [6], [6]]


def test_arbiter():
    """A long packet keeps the link; then the waiting one of highest priority, in order of arrival, goes."""
    link = Arbiter()
    out = [r for p in ((0, 3, 0, 10), (1, 1, 1, 2), (2, 0, 2, 2), (3, 0, 3, 2), (30, 2, 4, 1)) for r in link.feed(dict(zip(("arrival", "priority", "id", "beats"), p, strict=True)))]
    assert [(r["id"], r["start"]) for r in out + link.finish()] == [(0, 0), (2, 10), (3, 12), (1, 14), (4, 30)]


def test_file_digests(spark, tmp_path):
    for name, data in (("b.bit", b"abc"), ("a.bit", b"z")):
        (tmp_path / name).write_bytes(data)
    got = [tuple(r) for r in analysis.file_digests(spark, str(tmp_path)).collect()]
    assert got == [(n, len(d), hashlib.sha256(d).hexdigest(), hashlib.sha1(d).hexdigest()) for n, d in (("a.bit", b"z"), ("b.bit", b"abc"))]


def test_filter_contract(spark):
    good = dsp.filter_contract(spark, dsp.HALF_BAND).first()
    assert good.ok and good.taps == 41 and good.dc_sum == 131072 and good.ripple_db <= 0.25 and good.stop_db >= 55
    assert not dsp.filter_contract(spark, dsp.HALF_BAND | {1: 41000}).first().ok


def test_half_band_over_blocks(spark, monkeypatch):
    """Cut into blocks of 64 places the filter gives the same as over whole channels."""
    df = spark.range(1000).select((F.col("id") * 7919 % 2000 - 1000).cast("int").alias("i"), (F.col("id") % 97).cast("int").alias("q"), F.col("id").alias("n"), F.lit(0).alias("channel"))
    whole = sorted(map(tuple, dsp.half_band(df).collect()))
    monkeypatch.setattr(dsp, "BLOCK", 64)
    assert sorted(map(tuple, dsp.half_band(df).collect())) == whole and len(whole) == 481


def test_payload_sources(spark, tmp_path):
    """One packet a file; the SPEC payload's table function; the state of a trigger."""
    (tmp_path / "p.bin").write_bytes(b"x" * 9)
    assert tuple(captures.packet_files(spark, str(tmp_path)).first()) == ("p.bin", b"x" * 9)
    codec.register(spark)
    body = np.arange(2 * 2 * 3 * 2, dtype="<i2").tobytes()
    spark.createDataFrame([(bytes(128) + body,)], "packet binary").createOrReplaceTempView("s")
    rows = spark.sql("SELECT t, chan, input, i, q FROM s, LATERAL spec_payload(packet, 8, 2, 2, 3)").collect()
    assert [tuple(r) for r in rows[:4]] == [(0, 8, 0, 0, 1), (0, 8, 1, 2, 3), (0, 8, 2, 4, 5), (0, 9, 0, 6, 7)] and len(rows) == 12 and rows[-1].t == 1
    captures.latest_state(spark.createDataFrame([(1,)], "x int"), 5, str(tmp_path / "state"))
    captures.latest_state(spark.createDataFrame([(2,)], "x int"), 6, str(tmp_path / "state"))
    assert [(r.x, r.epoch) for r in spark.read.json(str(tmp_path / "state")).collect()] == [(2, 6)]
    captures.to_json_lines(spark.createDataFrame([(True, ["A"])], "ok boolean, errors array<string>"), str(tmp_path / "gate"))
    assert spark.read.text(str(tmp_path / "gate")).first().value == '{"ok":true,"errors":["A"]}'


def test_ring():
    ring = Ring(2)
    for write in (True, True, True, False, True):
        ring.feed({"write": write})
    assert ring.summary() == {"kept": 3, "dropped": 1, "high_water": 2}


def test_stabiliser():
    axis, s = np.arange(4.0), spectrum.Stabiliser()
    def show(db, peak=1.0, snr=30.0, clip=False):
        r = s.feed({"frame": 0, "axis_mhz": axis, "dbfs": np.full(4, db), "peak_mhz": peak, "peak_dbfs": db, "rms_dbfs": db, "snr_db": snr, "clipped": clip})[0]
        return r["display_dbfs"], [w for w in r["reason"].split(",") if w]

    assert show(-20.0)[1] == []
    power = 0.25 * 10**-1.9 + 0.75 * 10**-2
    assert show(-19.0)[0] == pytest.approx(np.full(4, 10 * math.log10(power)))
    assert show(-19.0, 9.0)[1] == ["peak_jump"] and show(-5.0)[1] == ["amp_jump", "rms_jump"] and show(-19.0, snr=3)[1] == ["snr"] and show(-19.0, clip=True)[1] == ["clipped"]
    s.reset()
    assert show(-5.0)[1] == []


def test_sync_errors(spark):
    first, end = {}, {}
    for r in sorted(receiver.q_sync(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.tick):
        end[r.board] = (r.state, r.error)
        if r.error:
            first.setdefault(r.board, r.error)
    assert end[0] == ("STREAMING", 0)
    assert all(first[b] == b for b in range(1, 14))


def test_epoch_machine():
    ok = {"arm": True, "ref_locked": True, "rfdc_ready": True, "sync_error": False, "stop": False, "reset": False, "mode": "external", "pps": True, "soft": False}
    state, seen = "RESET", []
    for _ in range(7):
        state = gates.epoch_step(state, ok)
        seen.append(state)
    assert seen == ["CLOCK_CONFIG", "RFDC_CONFIG", "WAIT_LOCK", "WAIT_PPS", "ARMED", "STREAMING", "STREAMING"]
    assert gates.epoch_step("STREAMING", ok | {"stop": True}) == "STOPPING" and gates.epoch_step("ARMED", ok | {"rfdc_ready": False}) == "ERROR" and gates.epoch_step("ERROR", ok) == "ERROR" and gates.epoch_step("ERROR", ok | {"reset": True}) == "RESET"


def test_profiles_and_alignment(spark):
    got = {(r.mhz, r["mode"]): (r.flows, r.payload_mbps, r.allowed) for r in flows.q_profiles(spark, "").collect()}
    assert [got[k][:2] for k in ((100, "time_only"), (100, "spec_only"), (100, "time_spec"), (200, "time_only"), (200, "spec_only"))] == [(8, 31948.8), (16, 31948.8), (24, 63897.6), (8, 63897.6), (16, 63897.6)]
    assert not got[200, "time_spec"][2]
    rule = lambda m, a: gates.first_sample_rule(F.lit(m), F.lit(a))
    assert [tuple(v) for v in values(spark, rule(20, False), rule(100, False), rule(100, True), rule(200, False))] == [(32, 0), (8, 0), (8, 4), (4, 0)]


def test_route_cases(spark):
    table = spark.createDataFrame([(0, False, 0, 256, 1), (1, True, 0, 256, 2), (2, True, 0, 512, 3), (3, True, 512, 0, 4)], "route_id int, enable boolean, chan0 int, chan_count int, endpoint_id int")
    rows = spark.createDataFrame([(0, 256), (64, 64), (200, 100), (500, 20), (512, 1), (0, 0)], "chan0 int, chan_count int")
    got = {(r.chan0, r.chan_count): r.route_id for r in routes.spec_routes(rows, table).collect()}
    assert got == {(0, 256): 1, (64, 64): 1, (200, 100): 2, (500, 20): None, (512, 1): None, (0, 0): None}
    with pytest.raises(Exception, match="at most 64 rows"):
        routes.small(spark.range(65)).collect()
    assert routes.small(spark.range(64)).count() == 64


ENDPOINTS = [(k, "TIME" if k < 8 else "SPEC", True, "10.0.1.16", "08:c0:eb:d5:95:b2", 4000 + k, 4300 + k) for k in range(24)]
DACS = [(k, True, 100.0, 25.0, 0.0) for k in range(8)]


def broken(spark, **changes):
    row = {"bandwidth_mhz": 100, "mode": "time_spec", "center_mhz": 100.0, "board_id": 0, "source_ip": "10.20.30.40", "source_mac": "02:AA:BB:CC:DD:EE", "endpoints": ENDPOINTS, "channels": DACS} | changes
    schema = f"bandwidth_mhz int, mode string, center_mhz double, board_id int, source_ip string, source_mac string, endpoints array<struct<{config.ENDPOINT.replace(' ', ':').replace(',:', ',')}>>, channels array<struct<{config.CHANNEL.replace(' ', ':').replace(',:', ',')}>>"
    df = spark.createDataFrame([tuple(row.values())], schema)
    return config.configuration_errors(df).first().errors, config.request_error(df).first().error, df


def with_(rows, k, at, value):
    return [r[:at] + (value,) + r[at + 1 :] if i == k else r for i, r in enumerate(rows)]


@pytest.mark.parametrize("changes, errors, request_", [
    ({}, [], None),
    ({"bandwidth_mhz": 200}, ["PROFILE"], "PROFILE"),
    ({"bandwidth_mhz": 200, "mode": "SPEC only"}, [], "PROFILE"),
    ({"source_ip": "0.0.0.0"}, ["SOURCE_IP"], "SOURCE_IP"),
    ({"source_ip": "239.1.2.3", "source_mac": "00:00:00:00:00:00"}, ["SOURCE_IP", "SOURCE_MAC"], "SOURCE_IP"),
    ({"source_ip": "255.255.255.255"}, ["SOURCE_IP"], "SOURCE_IP"),
    ({"source_mac": "01:00:5e:00:00:01"}, ["SOURCE_MAC"], "SOURCE_MAC"),
    ({"source_mac": "bad"}, ["SOURCE_MAC"], "SOURCE_MAC"),
    ({"board_id": 65536}, ["BOARD_ID"], None),
    ({"endpoints": with_(ENDPOINTS, 3, 3, "999.1.1.1")}, ["DESTINATION_IP"], "ENDPOINT_IP"),
    ({"endpoints": with_(ENDPOINTS, 3, 4, "bad")}, ["DESTINATION_MAC"], "ENDPOINT_MAC"),
    ({"endpoints": with_(ENDPOINTS, 3, 6, 0)}, ["DESTINATION_PORT"], "ENDPOINT_PORT"),
    ({"endpoints": with_(ENDPOINTS, 3, 5, 65536)}, ["SOURCE_PORT"], "ENDPOINT_PORT"),
    ({"endpoints": ENDPOINTS[1:]}, ["TIME_ENDPOINTS"], "ENDPOINT_COUNT"),
    ({"endpoints": with_(ENDPOINTS, 9, 0, 8)}, [], "ENDPOINT_ID"),
    ({"channels": with_(with_(DACS, 0, 2, 50.0), 1, 2, 161.44)}, [], None),
    ({"channels": with_(DACS, 1, 2, 161.441)}, ["NYQUIST_BAND"], None),
    ({"channels": with_(DACS, 1, 2, float("nan"))}, ["FREQUENCY", "NYQUIST_BAND"], None),
    ({"channels": with_(DACS, 1, 3, -1.0)}, ["AMPLITUDE"], None),
    ({"channels": with_(DACS, 1, 4, 181.0)}, ["PHASE"], None),
    ({"mode": None, "source_ip": None, "center_mhz": None}, ["MODE", "PROFILE", "CENTER", "SOURCE_IP", "NYQUIST_BAND"], "PROFILE"),
])
def test_configurations(spark, changes, errors, request_):
    got, first, df = broken(spark, **changes)
    assert got == errors and first == request_
    if errors:
        with pytest.raises(Exception, match=errors[0]):
            config.configured(df).collect()
    else:
        assert config.configured(df).first().source_mac == "02:aa:bb:cc:dd:ee"


def test_lag_and_delay(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (80, 2))
    a = spark.createDataFrame([(0, n, int(i), int(q)) for n, (i, q) in enumerate(x)], "k int, n long, i long, q long")
    assert spectrum.lag_search(a, a.withColumn("n", F.col("n") + 3), "k", 5).first().lag == 3
    line = spark.createDataFrame([(0, float(f), 0.5 * f + 1, w) for f, w in zip(range(6), (1.0, 0.5, 0.7, 1.0, 0.9, 0.3), strict=True)], "k int, x double, y double, w double")
    assert spectrum.weighted_slope(line, "k", "x", "y", "w").first().slope == pytest.approx(0.5)


def test_spectrum_of_a_tone(spark):
    df = captures.synthetic_tone(spark, 512, 0b11, 0, 245.76e6, 100e6, 110e6, phase_step_deg=90)
    s = spectrum.spectra(df, "channel", 245.76e6).toPandas()
    top = s.loc[s.groupby("channel")["dbfs"].idxmax()]
    assert top["frequency_hz"].tolist() == pytest.approx([10e6, 10e6], abs=245.76e6 / 4096)
    assert top["dbfs"].tolist() == pytest.approx([20 * math.log10(2048 / 32768)] * 2, abs=0.05)
    p = {r.channel: r for r in spectrum.projection(df, "channel", 10e6 / 245.76e6).collect()}
    assert p[0].amplitude == pytest.approx(2048, abs=0.5) and p[1].phase_deg == pytest.approx(90, abs=0.05) and p[0].residual < 1e-3
    z = {r.n: r.i + 1j * r.q for r in df.filter("channel = 0").collect()}
    r = spectrum.resample(df.filter("channel = 0"), "channel", 512).toPandas()
    assert np.abs(r["i"] + 1j * r["q"] - [z[n] for n in range(512)]).max() < 1e-6


def test_channelise_is_an_fft(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, 8)
    df = spark.createDataFrame([(0, 0, k, int(v), 0) for k, v in enumerate(x)], "channel int, frame long, phase int, i int, q int")
    out = spectrum.channelise(df, 8).orderBy("bin").toPandas()
    assert np.allclose(out["re"] + 1j * out["im"], np.fft.fft(x) / 8)


def test_capture_source(spark, tmp_path):
    some = framed(spark, *((struct.pack("<I", n), 4000, 4299 + n) for n in range(4)))
    for k in (2, 0):
        captures.write_pcap(str(tmp_path / f"{k}.pcap"), [(100 + n, f) for n, f in enumerate(some)])
    stream = captures.frames(spark, str(tmp_path), stream=True, files_per_trigger=1)
    q = stream.writeStream.format("memory").queryName("captured").start()
    q.processAllAvailable()
    captures.write_pcap(str(tmp_path / "1.pcap"), [(100 + n, f) for n, f in enumerate(some)])  # a name between those before
    q.processAllAvailable()
    q.stop()
    df = captures.frames(spark, str(tmp_path))
    assert df.count() == 9 and {r.dst_port for r in df.collect()} == {4300, 4301, 4302}
    assert sorted(map(tuple, spark.table("captured").select("file", "number").collect())) == sorted(map(tuple, df.select("file", "number").collect()))
    assert captures.frames(spark, str(tmp_path), port_count=1).count() == 3
    assert df.select(codec.parse_frame(F.col("frame")).alias("p")).filter("p.error is null").count() == 9
    raw = tmp_path / "raw"
    raw.mkdir()
    captures.write_pcap(str(raw / "a.pcap"), [(0, b"payload")])
    assert captures.frames(spark, str(raw), "udp_payload").first().dst_port == 4300


def test_numpy_source(spark, tmp_path):
    z = np.arange(6) + 1j
    np.save(tmp_path / "a.npy", z)
    np.savez(tmp_path / "b.npz", x=np.stack([z.real, z.imag], -1))
    got = captures.numpy_captures(spark, str(tmp_path)).orderBy("file", "n").collect()
    assert [(r.file, r.re, r.im) for r in got] == [(f, float(k), 1.0) for f in ("a.npy", "b.npz") for k in range(6)]


def test_counter_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"ts":"2024-01-01T00:00:00Z","board_id":1,"counters":{"a":1,"b":2}}\n')
    assert {(r.name, r.value) for r in captures.counter_snapshots(spark, str(tmp_path)).collect()} == {("a", 1), ("b", 2)}
    df = spark.createDataFrame([(1, "NIC statistics:\n     rx_packets: 5\n     rx_discards_phy: 7\n")], "board_id int, text string")
    assert {(r.name, r.value) for r in captures.ethtool_counters(df).collect()} == {("rx_packets", 5), ("rx_discards_phy", 7)}


def test_messages():
    w = {"sample0": 1, "seq_no": 2, "seq_end": 3, "selected_mhz": 100, "detected_mhz": 200, "gap_before": True, "decimation": 2, "channels": [{"channel": 3, **{a: [1.0, 2.0] for a in ("x_us", "i", "q", "mag", "sample_rf")}, "rf_x_us": [0.0], "rf": [5.0, 6.0]}], **dict.fromkeys(("sample_rate_hz", "window_us", "center_mhz", "expected_mhz", "dac_mhz", "expected_baseband_mhz", "rf_samples_per_cycle", "baseband_samples_per_cycle", "rf_window_cycles", "captured_window_us"), 1.5)}
    m = captures.waveform_bytes(w)
    assert m[:4] == b"TFW5" and len(m) == 160 + 5 * 8 + 2 * 4 and struct.unpack_from("<I", m, 32)[0] == 3 and struct.unpack_from("<f", m, len(m) - 4)[0] == 5.0
    s = captures.spectrum_bytes({"sample0": 1, "frame_id": 2, "lanes": [{"amplitude": [1.0], "phase_rad": [2.0], "power_db": [3.0]}]})
    assert len(s) == 128 + 12 and s[:4] == b"TSP3"


def _machines(spark, sf):
    from fluxframe.operators import receiver as r

    p = packets(spark, sf)
    blocks = r._blocks(spark, sf)
    gate_ = p.select("board_id", "e", "seq_no", F.col("e").alias("frame_id"), F.lit(16).alias("block_count"), F.expr("cast(e % 16 as int)").alias("block_index"), (F.col("e") * 10).alias("t_ms"))
    return {
        "reorder": (r._flows(spark, sf), "flow_id", "arrival", lambda s: Reorder(2, 100, s), r.REORDER, True),
        "assembler": (blocks, "block_count", "e", lambda s: Assembler(state=s), "key int, frame_group long, frame_id long, coverage int, mask_lo long, mask_hi long", False),
        "capture": (r._flows(spark, sf).select("flow_id", "arrival", "seq_no"), "flow_id", "arrival", lambda s: Capture(16, 1, 24, s), "key int, first long, last long, packets long", False),
        "preview": (gate_, "board_id", "e", lambda s: PreviewGate(3, 100, 500, s), "key int, frame_group long, block_index int, seq_no long", False),
        "ring": (p.select("board_id", "e", (F.col("e") * 31 % 100 < 55).alias("write")), "board_id", "e", lambda s: Ring(6, s), "key int, kept long, dropped long, high_water long", True),
        "sync": (r._sync_events(spark, sf).filter("board < 30"), "board", "tick", lambda s: Steps(gates.SYNC_START, gates.sync_step, "tick", s), "key int, tick int, state string, error int", False),
    }


@pytest.mark.parametrize("name", ["reorder", "assembler", "capture", "preview", "ring", "sync"])
def test_stream_equals_batch(spark, sf, tmp_path, name):
    """Each machine over a table and, in several batches, over a stream."""
    df, key, order, make, schema, summary = _machines(spark, sf)[name]
    cut = df.agg(F.percentile(order, F.lit(0.5))).first()[0]
    for part in (df.filter(F.col(order) < cut), df.filter(F.col(order) >= cut)):
        part.repartition(1).sortWithinPartitions(order).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    want = {tuple(r) for r in run_batch(df, key, order, make, schema, summary).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_stream(stream, key, order, make, schema, summary).writeStream.format("memory").queryName(f"m_{name}").outputMode("update" if summary else "append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table(f"m_{name}").collect()]
    last = {r[0]: r for r in got}  # a summary grows: each key's last one counts
    assert (set(last.values()) if summary else set(got)) == want


def test_stream_windows_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2, 8320, k // 4, k % 4) for k in range(40)], "s long, flow_id int, udp_payload_len int, frame_group long, block_index long").select(F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "flow_id", "udp_payload_len", "frame_group", "block_index")
    df.union(df).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, count in (("rates", windowed_rates(stream, 10, "0 seconds"), 6), ("blocks", first_blocks(stream), 40)):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() >= count


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert "gap_report" in entry.queries() and "gap_report" in entry.oracle_sql()
