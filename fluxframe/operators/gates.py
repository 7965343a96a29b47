"""Validation gates: rules over counters, rates and states as data, one engine for all of them; progress checks, sync state
machines, geometry.

A rule is (code, condition). gate() evaluates all rules of a row and gives classification, ok and the codes that failed, in
order of the rules.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.functions.bits import delta_mod
from fluxframe.plans.views import counters, packets, sql

Rules = list[tuple[str | Column, Column]]


def failed(rules: Rules) -> Column:
    """The codes of rules that are broken, as an array; a code can be a column, of a text in one line."""
    text = F.concat_ws("\n", *[F.when(bad, F.lit(code) if isinstance(code, str) else code) for code, bad in rules])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def gate(df: DataFrame, rules: Rules, name: str, keep: list[str]) -> DataFrame:
    """df's columns of keep with classification, ok and errors."""
    out = df.withColumn("errors", failed(rules))
    ok = F.size("errors") == 0
    return out.select(*keep, F.when(ok, f"{name}_PASS").otherwise(f"{name}_FAIL").alias("classification"), ok.alias("ok"), "errors")


def nonzero(columns: list[str]) -> Rules:
    return [(f"NONZERO_{c.upper()}", F.coalesce(F.col(c), F.lit(0)) != 0) for c in columns]


# Counters that must not move while a receiver is measured.
HOST_COUNTERS = ["parse_errors", "ring_drops", "worker_ring_drops", "kernel_drops", "app_drops", "seq_gaps", "frame_gaps", "sample0_gaps", "spec_seq_gaps", "spec_frame_gaps"]
# Of these a flow's own must not move either.
FLOW_COUNTERS = ["seq_gaps", "frame_gaps", "sample0_gaps", "spec_seq_gaps", "spec_frame_gaps"]
# Counters of the network card's interface that must not move.
NIC_COUNTERS = ["rx_dropped", "rx_errors", "rx_missed_errors", "rx_crc_errors"]
# The transmitter's counters that must not move.
BOARD_COUNTERS = [
    "pfb_capture_backpressure_count", "pfb_coeff_error_count", "pfb_data_halt_count", "pfb_frame_sample0_overflow_count", "pfb_overflow_count", "pfb_tile_overflow_count", "pfb_xfft_data_out_halt_count", "pfb_xfft_event_count", "pfb_xfft_fft_overflow_count",
    "pfb_xfft_status_halt_count", "pfb_xfft_tlast_missing_count", "pfb_xfft_tlast_unexpected_count", "rfdc_dropped_count", "science_dropped_beat_count", "spec_dropped_count", "time_dropped_count", "tx_route_error_count", "tx_route_miss_count",
]
# Counters that must be zero on the signal path.
SIGNAL_COUNTERS = ["rfdc_dropped_count", "science_dropped_beat_count", "pfb_overflow_count", "pfb_xfft_event_count", "pfb_xfft_tlast_missing_count", "pfb_xfft_tlast_unexpected_count", "pfb_xfft_fft_overflow_count", "pfb_xfft_data_out_halt_count", "pfb_capture_backpressure_count", "tx_route_miss_count", "tx_route_error_count"]


# The codes of this and the other gates' rules, and their thresholds.
def host_rules(core_flows: int = 24) -> Rules:
    """The receiver's gate, on a row with mhz, mode, elapsed, counts and counter differences. Flows and the card have rules of
    their own: flow_rules, preview_rules, nic_rules; host_gate puts all together."""
    time, spec = F.col("mode").isin("time_only", "time_spec"), F.col("mode").isin("spec_only", "time_spec")
    time_flows, spec_flows = F.when(time, 8).otherwise(0), F.when(spec, 16).otherwise(0)
    pps_least = F.when(F.col("mhz") == 100, 470_000).otherwise(950_000)
    payload_least = F.when((F.col("mhz") == 200) | (F.col("mode") == "time_spec"), 63_000).otherwise(31_000)
    rate = lambda c: F.col(c) / F.col("elapsed")
    return [
        ("TIME_FLOW_COUNT_MISMATCH", F.col("active_time_flows") != time_flows),
        ("SPEC_FLOW_COUNT_MISMATCH", F.col("active_spec_flows") != spec_flows),
        ("FLOW_COUNT_MISMATCH", F.col("active_flows") != time_flows + spec_flows),
        ("CAPTURE_FLOW_CAPACITY_MISMATCH", F.col("flows") != core_flows),
        ("ACTIVE_WORKERS_LOW", F.col("active_workers") < time_flows + spec_flows),
        ("TIME_PPS_LOW", time & (rate("time_packets") < pps_least)),
        ("SPEC_PPS_LOW", spec & (rate("spec_packets") < pps_least)),
        ("TIME_PACKETS_IN_SPEC_ONLY", ~time & (F.col("time_packets") != 0)),
        ("SPEC_PACKETS_IN_TIME_ONLY", ~spec & (F.col("spec_packets") != 0)),
        ("COMBINED_PAYLOAD_RATE_LOW", (F.col("time_packets") + F.col("spec_packets")) * 8320 * 8 / F.col("elapsed") / 1e6 < payload_least),
        *nonzero(HOST_COUNTERS),
    ]


def flow_errors(flows: DataFrame, keys: list[str], core_flows: int = 24) -> DataFrame:
    """keys and flow_errors: what is wrong with each gate's flows, in order of flow, those that should be active first. flows has
    keys, mode, flow_id, present (whether the flow was reported after), and differences time_packets, spec_packets and
    FLOW_COUNTERS. A gate with nothing wrong has no row."""
    time, spec = F.col("mode") != "spec_only", F.col("mode") != "time_only"
    active = F.when(F.col("flow_id") < 8, time).otherwise(spec)
    moved = F.when(F.col("flow_id") < 8, F.col("time_packets")).otherwise(F.col("spec_packets"))
    name = lambda what: F.concat(F.lit("FLOW_"), F.col("flow_id").cast("string"), F.lit("_" + what))
    seen = active & F.coalesce("present", F.lit(False))
    checks = [(active & ~F.coalesce("present", F.lit(False)), "MISSING"), (seen & (F.coalesce(moved, F.lit(0)) <= 0), "NO_PACKETS")]
    checks += [(seen & (F.coalesce(F.col(c), F.lit(0)) != 0), c.upper()) for c in FLOW_COUNTERS]
    checks += [(~active & ((F.coalesce("time_packets", F.lit(0)) != 0) | (F.coalesce("spec_packets", F.lit(0)) != 0)), "INACTIVE_PACKETS")]
    wrong = functools.reduce(operator.or_, (F.coalesce(bad, F.lit(False)) for bad, _ in checks))  # texts are made for few flows
    bad = flows.filter(F.col("flow_id").between(0, core_flows - 1) & wrong).select(*keys, "flow_id", (~active).alias("idle"), failed([(name(what), bad) for bad, what in checks]).alias("said"))
    # at most core_flows rows a gate
    return bad.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idle", "flow_id", "said"))), lambda x: x["said"])).alias("flow_errors"))


def preview_rules() -> Rules:
    """Displays that should be live, on a row with mode, their update rates, and the spectrum preview's completeness."""
    time, spec = F.col("mode") != "spec_only", F.col("mode") != "time_only"
    slow = lambda c: F.coalesce(F.col(c), F.lit(0.0)) < 1
    return [
        ("WAVEFORM_PREVIEW_NOT_LIVE", time & slow("display_update_hz")),
        ("SPECTRUM_PREVIEW_NOT_LIVE", spec & slow("spectrum_update_hz")),
        ("SPEC_PREVIEW_INCOMPLETE", spec & (~F.coalesce("preview_complete", F.lit(False)) | (F.coalesce("coverage_blocks", F.lit(0)) < 16))),
    ]


def nic_rules() -> Rules:
    """The card's counters, on a row with their differences and the sum of its physical discards."""
    return [*((f"NIC_{c.upper()}", F.coalesce(F.col(c), F.lit(0)) != 0) for c in NIC_COUNTERS), ("NIC_PHYSICAL_DISCARD", F.coalesce("physical_discards", F.lit(0)) != 0)]


def host_gate(totals: DataFrame, flows: DataFrame, keys: list[str]) -> DataFrame:
    """classification, ok and errors of each gate (keys): totals, flows, previews and card, in this order."""
    out = totals.join(flow_errors(flows, keys), keys, "left")
    errors = F.concat(failed(host_rules()), F.coalesce("flow_errors", F.array().cast("array<string>")), failed([*preview_rules(), *nic_rules()]))
    out = out.withColumn("errors", errors)
    ok = F.size("errors") == 0
    name = F.concat(F.lit("HOST_"), F.col("mhz").cast("string"), F.lit("MHZ_"), F.col("mode"), F.when(ok, "_PASS").otherwise("_FAIL"))
    return out.select(*keys, name.alias("classification"), ok.alias("ok"), "errors")


# The board's core, clock reference and sync mode, its anti-alias filter, floors of packets a second and of payload.
CORE_VERSION, OLD_CORE_VERSION = 0x00010031, 0x00010025
EXTERNAL_10MHZ, EXTERNAL_PPS, NO_INJECTION = 0, 0, 0xFF00
AA_TAPS, AA_COEFF_VERSION = 41, 0xAA100041
LEAST_PPS, LEAST_PAYLOAD_MBPS = 470_000, 31_000


def _off(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) == 0


def _is_not(c: str, x: int) -> Column:
    return F.coalesce(F.col(c) != x, F.lit(True))


def _wrong_core(version: int) -> tuple[Column, Column]:
    return F.format_string(f"WRONG_CORE_VERSION expected 0x{version:08x} got 0x%08x", F.coalesce(F.col("core_version"), F.lit(0))), _is_not("core_version", version)


# The codes of the gates' rules, in their order.
def board_rules() -> Rules:
    """The transmitter's gate for one stream at 100 MHz, on a row with mode (time_only or spec_only), status words, differences of
    counters over `elapsed` seconds, rates, and how many routes are enabled and hit."""
    time, spec = F.col("mode") == "time_only", F.col("mode") == "spec_only"
    low = lambda what, c, least: (F.format_string(f"{what} %.3f < {least}", c), c < least)
    route = lambda kind, n: (F.col(f"{kind}_routes") != n) | (F.col(f"{kind}_routes_hit") < F.col(f"{kind}_routes"))
    time_low, spec_low = low("TIME_PPS_LOW", F.col("time_pps"), LEAST_PPS), low("SPEC_PPS_LOW", F.col("spec_pps"), LEAST_PPS)
    return [
        _wrong_core(CORE_VERSION),
        ("WRONG_CLOCK_REF", _is_not("clock_ref", EXTERNAL_10MHZ)),
        ("WRONG_SYNC_MODE", _is_not("configured_sync_mode", EXTERNAL_PPS) | _is_not("active_sync_mode", EXTERNAL_PPS)),
        ("EXTERNAL_PPS_NOT_READY", _off("pps_recent") | (F.coalesce("pps_count", F.lit(0)) <= 0)),
        ("DIAGNOSTIC_INJECTION_ENABLED", _is_not("diag_control", NO_INJECTION)),
        ("SCIENCE_BANDWIDTH_MISMATCH", _is_not("science_mhz", 100)),
        ("TIME_ENABLE_MISMATCH", _off("time_enabled") == time),
        ("SPEC_ENABLE_MISMATCH", _off("spec_enabled") == spec),
        ("SCIENCE_100MHZ_ANTIALIAS_NOT_READY", _off("aa_active") | _off("aa_primed")),
        ("SCIENCE_100MHZ_ANTIALIAS_CONTRACT_MISMATCH", _is_not("aa_taps", AA_TAPS) | _is_not("aa_coeff_version", AA_COEFF_VERSION)),
        ("CMAC_LIVE_TX_NOT_ENABLED", _is_not("udp_dry_run_active", 0) | _off("cmac_enable")),
        *nonzero(BOARD_COUNTERS),
        ("SPEC_PACKETS_PRESENT_IN_TIME_ONLY", time & (F.col("spec_packet_count") != 0)),
        ("TIME_PACKETS_PRESENT_IN_SPEC_ONLY", spec & (F.col("time_packet_count") != 0)),
        (time_low[0], time & time_low[1]),
        (spec_low[0], spec & spec_low[1]),
        low("COMBINED_PAYLOAD_LOW", F.col("payload_mbps"), LEAST_PAYLOAD_MBPS),
        ("TIME_ROUTE_CONTRACT_FAILED", time & route("time", 8)),
        ("TIME_ROUTE_ENABLED_IN_SPEC_ONLY", ~time & (F.col("time_routes") != 0)),
        ("SPEC_ROUTE_CONTRACT_FAILED", spec & route("spec", 16)),
        ("FENGINE_SCIENCE_NOT_VALID", spec & _off("fengine_science_valid")),
        *[(code, spec & bad) for code, bad in (("PFB_TAPS_NOT_4", _is_not("pfb_taps", 4)), ("PFB_NOT_ACTIVE", _off("pfb_active")), ("PFB_COEFF_NOT_VALID", _off("pfb_coeff_active_valid")), ("PFB_CHAN_COUNT_NOT_256", _is_not("pfb_chan_count", 256)), ("PFB_TIME_COUNT_NOT_1", _is_not("pfb_time_count", 1)))],
        ("SPEC_ROUTE_ENABLED_IN_TIME_ONLY", ~spec & (F.col("spec_routes") != 0)),
        ("PFB_ACTIVE_IN_TIME_ONLY", ~spec & ~_off("pfb_active")),
    ]


def link_blockers(one_fault: bool = True) -> Rules:
    """What keeps packets from leaving the board at all, apart from errors."""
    local, remote = ~_off("tx_local_fault"), ~_off("tx_remote_fault")
    faults = [("CMAC_FAULT", local | remote)] if one_fault else [("CMAC_LOCAL_FAULT", local), ("CMAC_REMOTE_FAULT", remote)]
    return [("GT_NOT_LOCKED", _off("gt_locked")), ("CMAC_RESET_NOT_DONE", _off("cmac_reset_done")), ("CMAC_TX_NOT_READY", _off("cmac_tx_ready")), *faults]


def science_rules(least_packets: int = 1) -> Rules:
    """The gate of an earlier core, whose 64 spectrum routes carry 64 channels each; packets have to move, at no given rate."""
    time, spec = F.col("mode").isin("time_only", "time_spec"), F.col("mode").isin("spec_only", "time_spec")
    moved = lambda c: ~_off(c)
    few = lambda c: F.coalesce(F.col(c), F.lit(0)) < least_packets
    return [
        _wrong_core(OLD_CORE_VERSION),
        ("TX_STILL_DRY_RUN", _is_not("udp_dry_run_active", 0)), ("CMAC_TX_NOT_ENABLED", _off("cmac_enable")), ("FRAME_BUILDER_NOT_ENABLED", _off("frame_builder_enabled")), ("CMAC_TX_UNDERFLOW", moved("tx_underflow")), ("CMAC_TX_OVERFLOW", moved("tx_overflow")),
        ("FENGINE_SCIENCE_NOT_VALID", _off("fengine_science_valid")), ("PFB_FFT_NOT_READY", spec & moved("pfb_fft_not_ready")), ("FENGINE_OVERFLOW", spec & moved("pfb_overflow_count")), ("FENGINE_XFFT_EVENT", spec & moved("pfb_xfft_event_count")), ("FENGINE_TILE_OVERFLOW", spec & moved("pfb_tile_overflow_count")),
        ("SPEC_ROUTE_INCOMPLETE", spec & moved("spec_route_incomplete")), ("SCIENCE_RATE_DROPPED", moved("science_dropped_beat_count")), ("RFDC_DROPPED", moved("rfdc_dropped_count")), ("SCIENCE_OUTPUT_MODE_MISMATCH", F.coalesce(F.col("output_mode") != F.col("mode"), F.lit(True))),
        ("TIME_PACKET_COUNTER_NOT_INCREMENTING", time & few("time_packet_count")), ("TIME_DROPPED", time & moved("time_dropped_count")), ("SPEC_PACKET_COUNTER_NOT_INCREMENTING", spec & few("spec_packet_count")), ("SPEC_DROPPED", spec & moved("spec_dropped_count")), ("TX_FRAME_COUNTER_NOT_INCREMENTING", few("tx_frame_built_count")),
        ("TX_ROUTE_MISS", moved("tx_route_miss_count")), ("TX_ROUTE_ERROR", moved("tx_route_error_count")), ("TX_FRAME_DROPPED", moved("tx_frame_dropped_count")),
        ("SPEC_ROUTE_COVERAGE_INCOMPLETE", spec & (F.col("spec_routes_hit") < 64)), ("SPEC_ROUTE_CHAN_COUNT_BAD", spec & moved("spec_routes_odd_count")), ("SPEC_ROUTE_ENDPOINT_RANGE_BAD", spec & moved("spec_routes_odd_endpoint")), ("SPEC_ROUTE_HITS_MISSING", spec & moved("spec_routes_unhit")),
    ]


def transmitter_gate(df: DataFrame, rules: Rules, blockers: Rules, name: str, keys: list[str]) -> DataFrame:
    """keys, classification, ok, errors, blockers and rates (time_pps, spec_pps, payload_mbps) of rows with mhz, mode, elapsed,
    status words and differences of counters. Rates are there for the rules."""
    seconds = F.greatest(F.col("elapsed"), F.lit(1e-6))
    df = df.withColumns({"time_pps": F.col("time_packet_count") / seconds, "spec_pps": F.col("spec_packet_count") / seconds, "payload_mbps": (F.col("time_packet_count") + F.col("spec_packet_count")) * 8320.0 * 8.0 / seconds / 1e6})
    out = df.withColumns({"errors": failed(rules), "blockers": failed(blockers)})
    ok = (F.size("errors") == 0) & (F.size("blockers") == 0)
    said = F.concat(F.lit(name + "_"), F.col("mhz").cast("string"), F.lit("MHZ_"), F.col("mode"), F.when(ok, "_PASS").otherwise("_FAIL"))
    return out.select(*keys, said.alias("classification"), ok.alias("ok"), "errors", "blockers", "time_pps", "spec_pps", "payload_mbps")


def packet_rules(ip: str, ports: Column, stream: int) -> Rules:
    """What a parsed packet is expected to be: its destination and its stream."""
    return [("DST_IP", ~F.coalesce(F.col("dst_ip") == ip, F.lit(False))), ("DST_PORT", ~F.coalesce(F.col("dst_port") == ports, F.lit(False))), ("STREAM", ~F.coalesce(F.col("stream_type") == stream, F.lit(False)))]


def pipeline_state(df: DataFrame) -> DataFrame:
    """df with accepting (a stream may start), flush_clean (nothing of an old run is left) and stale (a science frame still holds
    the output), from flags of which an absent downstream_ready counts as ready."""
    ready, full = F.coalesce(F.col("downstream_ready"), F.lit(1)) != 0, F.coalesce(F.col("bridge_full"), F.lit(0)) != 0
    held = (F.coalesce(F.col("mux_locked"), F.lit(0)) != 0) & F.coalesce(F.col("mux_source"), F.lit(0)).isin(1, 2)
    return df.withColumns({"accepting": (F.coalesce(F.col("streaming"), F.lit(0)) != 0) & ready & ~full, "flush_clean": ready & ~full & ~held, "stale": held})


def signal_rules(core_version: int = 0x00010031) -> Rules:
    ready = (F.col("aa_active") == 1) & (F.col("aa_primed") == 1)
    return [
        ("WRONG_CORE_VERSION", F.col("core_version") != core_version),
        ("DIAGNOSTIC_INJECTION_ENABLED", F.col("diag_control") != 0xFF00),
        *nonzero(SIGNAL_COUNTERS),
        ("AA100_NOT_READY", (F.col("mhz") == 100) & ~ready),
        ("AA100_ACTIVE_AT_200MHZ", (F.col("mhz") != 100) & (F.col("aa_active") == 1)),
    ]


def link_rules(core_version: int = 0x00010031) -> Rules:
    return [
        ("WRONG_CORE_VERSION", F.col("core_version") != core_version),
        *[(label, F.col(c) == 0) for c, label in (("gt_locked", "GT_NOT_LOCKED"), ("cmac_reset_done", "CMAC_RESET_NOT_DONE"), ("cmac_tx_ready", "CMAC_TX_NOT_READY"))],
        *[(f"CMAC_{c.upper()}", F.col(f"tx_{c}") != 0) for c in ("local_fault", "remote_fault")],
        *[(f"CMAC_TX_{c.upper()}", F.col(f"tx_{c}") != 0) for c in ("underflow", "overflow")],
    ]


def discards(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rises of a network card's counters whose names tell of lost packets, by board."""
    x = before.select("board_id", "name", F.col("value").alias("b")).join(after.select("board_id", "name", F.col("value").alias("a")), ["board_id", "name"], "full_outer")
    rise = F.greatest(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)), F.lit(0))
    return x.filter(F.col("name").rlike("(?i)rx.*(discard|drop|miss|error)|prio.*discard")).groupBy("board_id").agg(F.sum(rise).alias("discards"))


def sustained(df: DataFrame, keys: str, order: str, counters_: list[str], still: list[str]) -> DataFrame:
    """The first of two neighbouring healthy snapshots between which all counters advance and the others stand still."""
    w = Window.partitionBy(keys).orderBy(order)
    good = F.col("healthy") & F.lag("healthy").over(w)
    for c in counters_:
        good &= F.col(c) > F.lag(c).over(w)
    for c in still:
        good &= F.col(c) == F.lag(c).over(w)
    return df.withColumn("good", good).groupBy(keys).agg(F.min(F.when(F.col("good"), F.col(order))).alias("since"))


def common_rule(df: DataFrame, key: str, rule: list[str], id_: str) -> DataFrame:
    """Of each key's boards: whether all have one rule (the same values in these columns), and none repeats an id."""
    return df.groupBy(key).agg((F.countDistinct(*rule) == 1).alias("common_rule"), (F.countDistinct(id_) == F.count("*")).alias("unique_ids"))


def paired(snapshot: DataFrame, preview: DataFrame, header: DataFrame, key: str) -> DataFrame:
    """Three sources of one capture (key, sample0 each), joined, with the distances of their first samples from the snapshot's;
    coherent if there is none."""
    of = lambda df, name: df.select(key, F.col("sample0").alias(name))
    out = of(snapshot, "s").join(of(preview, "v"), key).join(of(header, "h"), key)
    return out.select(key, (F.col("v") - F.col("s")).alias("preview_delta"), (F.col("h") - F.col("s")).alias("header_delta"), ((F.col("v") == F.col("s")) & (F.col("h") == F.col("s"))).alias("coherent"))


def compared(written: DataFrame, read: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """The same capture read twice: by group how many places were compared, how many differ, and the first of them."""
    x = written.select(key, group, F.col(value).alias("_a")).join(read.select(key, F.col(value).alias("_b")), key).withColumn("bad", ~F.col("_a").eqNullSafe(F.col("_b")))
    return x.groupBy(group).agg(F.count("*").alias("compared"), F.count_if("bad").alias("mismatches"), F.min(F.when(F.col("bad"), F.col(key))).alias("first"))


def rebased(df: DataFrame, key: str, sample0: str = "sample0") -> DataFrame:
    """df with observation_sample0: samples counted from each key's epoch, its first sample, modulo 2 ** 64."""
    epoch = df.groupBy(key).agg(F.min(sample0).alias("_epoch"))
    return df.join(epoch, key).withColumn("observation_sample0", delta_mod(F.col(sample0), F.col("_epoch"), 64)).drop("_epoch")


def order_audit(df: DataFrame, key: str, order: list[str], sample0: str, step: int) -> DataFrame:
    """Order of sample numbers by key: steps back, repeats, and holes of more than `step`."""
    d = df.withColumn("_d", F.col(sample0) - F.lag(sample0).over(Window.partitionBy(key).orderBy(*order)))
    return d.groupBy(key).agg(F.count_if(F.col("_d") < 0).alias("back"), F.count_if(F.col("_d") == 0).alias("repeats"), F.count_if(F.col("_d") > step).alias("holes"))


def first_sample_rule(mhz: Column, antialias: Column) -> Column:
    """(multiple, residue) that a first sample has to have."""
    pair = lambda m, r: F.struct(F.lit(m).alias("multiple"), F.lit(r).alias("residue"))
    return F.when(mhz == 20, pair(32, 0)).when((mhz == 100) & antialias, pair(8, 4)).when(mhz == 100, pair(8, 0)).when(mhz == 200, pair(4, 0))


# What can go wrong in a scheduled start, by code.
SYNC_ERRORS = {1: "PREPARE_BUSY", 2: "BAD_ALIGNMENT", 3: "GENERATION", 4: "MTS_NOT_VALID", 5: "REF_UNLOCKED", 6: "RFDC_NOT_READY", 7: "PPS_NOT_RECENT", 8: "BAD_STATE", 9: "TARGET_TOO_SOON", 10: "TARGET_MISSED", 11: "FIRST_SAMPLE_MISSED", 12: "SIGNAL_CHAIN_INVALID", 13: "EPOCH_TAI_INVALID"}
SYNC_STATES = ("IDLE", "PREPARED", "ARMED", "WAIT_EPOCH_SAMPLE", "PRIMING", "STREAMING", "ERROR")
MIN_LEAD_PPS = 2


def sync_step(s: dict, e: dict) -> dict:
    """The scheduler's next state: a pure function of state and event. Events: prepare, arm, pps, adc, science, abort; each
    carries ref_locked, rfdc_ready and pps_recent."""
    s = dict(s)
    event = e["event"]

    def wrong(code: int) -> dict:
        return s | {"state": "ERROR", "error": code}

    if event == "abort":
        return s | {"state": "IDLE", "error": 0}
    if event == "prepare":
        if s["state"] != "IDLE":
            return s | {"error": 1}
        for bad, code in ((e["first_sample0"] % e.get("multiple", 8) != e.get("residue", 0), 2), (e["generation"] == 0 or e["generation"] <= s["generation"], 3), (e["epoch_tai"] == 0, 13), (e["signal_chain_tag"] == 0, 12)):
            if bad:
                return wrong(code)
        return s | {"state": "PREPARED", "error": 0, "generation": e["generation"], "target": e["target_pps"], "first": e["first_sample0"], "mts": e["mts_result_id"], "epoch_raw": None}
    health = ((not e["ref_locked"], 5), (not e["rfdc_ready"], 6), (not e["pps_recent"], 7))
    if event == "arm":
        if s["state"] != "PREPARED":
            return wrong(8)
        for bad, code in ((s["mts"] == 0, 4), *health, (s["target"] < e["pps_count"] + MIN_LEAD_PPS, 9)):
            if bad:
                return wrong(code)
        return s | {"state": "ARMED"}
    if s["state"] in ("ARMED", "WAIT_EPOCH_SAMPLE", "PRIMING", "STREAMING"):
        for bad, code in health:
            if bad:
                return wrong(code)
    if event == "pps" and s["state"] == "ARMED":
        if e["pps_count"] == s["target"]:
            return s | {"state": "WAIT_EPOCH_SAMPLE"}
        return wrong(10) if e["pps_count"] > s["target"] else s
    if event == "adc" and s["state"] == "WAIT_EPOCH_SAMPLE":
        return s | {"state": "PRIMING", "epoch_raw": e["sample0"]}
    if event == "science" and s["state"] == "PRIMING":
        if e["sample0"] == s["first"]:
            return s | {"state": "STREAMING"}
        return wrong(11) if e["sample0"] > s["first"] else s
    return s


SYNC_START = {"state": "IDLE", "error": 0, "generation": 0, "target": 0, "first": 0, "mts": 0, "epoch_raw": None}

EPOCH_NEXT = {"RESET": "CLOCK_CONFIG", "RFDC_CONFIG": "WAIT_LOCK", "STOPPING": "RESET"}


def epoch_step(state: str, e: dict) -> str:
    """The start-up machine's next state at an event with arm, ref_locked, rfdc_ready, sync_error, stop, reset, mode and pps or soft."""
    if e["reset"]:
        return "RESET"
    healthy = e["ref_locked"] and e["rfdc_ready"] and not e["sync_error"]
    start = {"free_run": True, "software": e["soft"]}.get(e["mode"], e["pps"])
    if state in EPOCH_NEXT:
        return EPOCH_NEXT[state]
    if state == "CLOCK_CONFIG":
        return "RFDC_CONFIG" if e["ref_locked"] else state
    if state == "WAIT_LOCK":
        return "WAIT_PPS" if e["ref_locked"] and e["rfdc_ready"] else state
    if state == "WAIT_PPS":
        return "ARMED" if e["arm"] else "RESET"
    if state == "ARMED":
        return "STOPPING" if not e["arm"] else "ERROR" if not healthy else "STREAMING" if start else state
    if state == "STREAMING":
        return "STOPPING" if e["stop"] or not e["arm"] else "ERROR" if not healthy else state
    return state


def _host(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    df = packets(spark, sf_dir).select("e", F.when(e % 3 == 0, 200).otherwise(100).alias("mhz"), F.get(F.array(*map(F.lit, ["time_only", "spec_only", "time_spec"])), (F.floor(e / 3) % 3).cast("int")).alias("mode"), F.lit(10).alias("elapsed"))
    time, spec = F.col("mode") != "spec_only", F.col("mode") != "time_only"
    n = F.when(F.col("mhz") == 100, 4_800_000).otherwise(9_600_000)
    df = df.withColumns({"time_packets": F.when(time, n - e % 7 * 30_000).otherwise(0), "spec_packets": F.when(spec, n - e % 5 * 30_000).otherwise(F.when(e % 50 == 1, 1).otherwise(0)), "active_time_flows": F.when(time, 8).otherwise(0), "active_spec_flows": F.when(spec, 16).otherwise(F.when(e % 40 == 3, 1).otherwise(0)), "flows": F.when(e % 60 == 2, 23).otherwise(24)})
    df = df.withColumns({"active_flows": F.col("active_time_flows") + F.col("active_spec_flows"), "active_workers": F.col("active_time_flows") + F.col("active_spec_flows") - F.when(e % 70 == 5, 1).otherwise(0), "coverage_blocks": F.when(e % 33 == 4, 15).otherwise(16)})
    return df.withColumns({c: F.when(e % (90 + k) == 7, 1).otherwise(0) for k, c in enumerate(HOST_COUNTERS)})


def _host_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 flows of each gate; now and then one is missing, idle, has gaps, or sends though it should not."""
    e, f = F.col("e"), F.col("flow_id")
    df = _host(spark, sf_dir).select("e", "mode", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("flow_id"))
    hit = lambda m, r: (e + f) % m == r
    active = F.when(f < 8, F.col("mode") != "spec_only").otherwise(F.col("mode") != "time_only")
    n = F.when(hit(211, 3), 0).when(active, 1000).when(hit(307, 5), 2).otherwise(0)
    return df.withColumns({"present": ~hit(401, 7), "time_packets": F.when(f < 8, n).otherwise(0), "spec_packets": F.when(f >= 8, n).otherwise(0), **{c: F.when(hit(503 + 2 * k, 11), 1).otherwise(0) for k, c in enumerate(FLOW_COUNTERS)}})


def q_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    totals = _host(spark, sf_dir).withColumns({
        "display_update_hz": F.when(e % 21 == 8, 0.5).when(e % 22 != 9, 10.0), "spectrum_update_hz": F.when(e % 23 == 8, 0.9).otherwise(5.0), "preview_complete": e % 31 != 6,
        **{c: F.when(e % (110 + k) == 8, 1).otherwise(0) for k, c in enumerate(NIC_COUNTERS)}, "physical_discards": F.when(e % 120 == 9, 4).otherwise(0),
    })
    return host_gate(totals, _host_flows(spark, sf_dir), ["e"]).withColumn("errors", F.array_join("errors", ","))


#: A board's status an event, common to both engines: what a gate reads, with something wrong now and then.
_STATUS = {
    "mhz": "100", "mode": "case when e % 2 = 0 then 'time_only' else 'spec_only' end", "elapsed": "cast(10 as double)",
    **{c: f"case when e % {m} = 5 then {bad} else {good} end" for c, m, bad, good in (
        ("core_version", 73, 65584, 65585), ("clock_ref", 74, 1, 0), ("configured_sync_mode", 75, 2, 0), ("active_sync_mode", 76, 1, 0), ("pps_recent", 31, 0, 1), ("diag_control", 33, 1, 65280), ("science_mhz", 29, 200, 100), ("aa_active", 77, 0, 1), ("aa_primed", 78, 0, 1), ("aa_taps", 79, 40, 41),
        ("aa_coeff_version", 80, 1, 2853175361), ("gt_locked", 36, 0, 1), ("cmac_reset_done", 37, 0, 1), ("cmac_tx_ready", 38, 0, 1), ("tx_local_fault", 81, 1, 0), ("tx_remote_fault", 82, 1, 0), ("udp_dry_run_active", 83, 1, 0), ("cmac_enable", 84, 0, 1), ("fengine_science_valid", 85, 0, 1),
        ("pfb_taps", 19, 3, 4), ("pfb_coeff_active_valid", 44, 0, 1), ("pfb_chan_count", 45, 64, 256), ("pfb_time_count", 86, 2, 1), ("frame_builder_enabled", 87, 0, 1), ("tx_underflow", 88, 1, 0), ("tx_overflow", 89, 1, 0), ("pfb_fft_not_ready", 91, 1, 0), ("spec_route_incomplete", 92, 1, 0),
        ("tx_frame_built_count", 93, 0, 9), ("tx_frame_dropped_count", 94, 2, 0), ("spec_routes_odd_count", 95, 3, 0), ("spec_routes_odd_endpoint", 96, 1, 0), ("spec_routes_unhit", 97, 1, 0),
    )},
    "pps_count": "e % 32", "time_enabled": "case when (e % 2 = 0) = (e % 34 <> 2) then 1 else 0 end", "spec_enabled": "case when (e % 2 = 1) = (e % 35 <> 2) then 1 else 0 end", "pfb_active": "case when (e % 2 = 1) = (e % 42 <> 2) then 1 else 0 end",
    "time_packet_count": "case when e % 2 = 0 then 4800000 - e % 11 * 20000 when e % 27 = 2 then 3 else 0 end", "spec_packet_count": "case when e % 2 = 1 then 4800000 - e % 13 * 20000 when e % 28 = 2 then 3 else 0 end",
    "time_routes": "case when e % 2 = 0 then 8 - case when e % 39 = 1 then 1 else 0 end when e % 41 = 1 then 2 else 0 end", "time_routes_hit": "case when e % 2 = 0 then 8 - case when e % 17 = 0 or e % 39 = 1 then 1 else 0 end else 0 end",
    "spec_routes": "case when e % 2 = 1 then 16 - case when e % 43 = 1 then 1 else 0 end when e % 41 = 1 then 1 else 0 end", "spec_routes_hit": "case when e % 2 = 1 then 16 - case when e % 43 = 1 or e % 23 = 0 then 1 else 0 end else 0 end",
    **{c: f"case when e % {160 + k} = 1 then {k + 1} else 0 end" for k, c in enumerate(BOARD_COUNTERS)},
}
#: What differs for the earlier core's gate.
_SCIENCE = _STATUS | {"core_version": "case when e % 73 = 5 then 65573 + 256 else 65573 end", "mode": "case e % 3 when 0 then 'time_only' when 1 then 'spec_only' else 'time_spec' end", "output_mode": "case when e % 98 = 5 then 'monitor' else case e % 3 when 0 then 'time_only' when 1 then 'spec_only' else 'time_spec' end end", "spec_routes_hit": "64 - case when e % 23 = 0 then 1 else 0 end", "time_packet_count": "case when e % 21 = 4 then 0 else e end", "spec_packet_count": "case when e % 22 = 4 then 0 else e end"}


def _transmitters(spark: SparkSession, sf_dir: str, status: dict[str, str], rules: Rules, blockers: Rules, name: str) -> DataFrame:
    df = packets(spark, sf_dir).selectExpr("e", *[f"{x} AS {c}" for c, x in status.items()])
    out = transmitter_gate(df, rules, blockers, name, ["e"])
    return out.withColumns({**{c: F.array_join(c, ",") for c in ("errors", "blockers")}, **{c: F.round(c, 6) for c in ("time_pps", "spec_pps", "payload_mbps")}})


def q_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transmitters(spark, sf_dir, _STATUS, board_rules(), link_blockers(), "BOARD")


def q_science(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier core's gate."""
    return _transmitters(spark, sf_dir, _SCIENCE, science_rules(), link_blockers(False), "SCIENCE")


def q_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    df = packets(spark, sf_dir).select("e", F.when(e % 41 == 0, 0x00010030).otherwise(0x00010031).alias("core_version"), F.when(e % 43 == 0, 1).otherwise(0xFF00).alias("diag_control"), F.when(e % 2 == 0, 100).otherwise(200).alias("mhz"), (e % 5 != 1).cast("int").alias("aa_active"), (e % 6 != 2).cast("int").alias("aa_primed"), *[F.when(e % (50 + k) == 3, 2).otherwise(0).alias(c) for k, c in enumerate(SIGNAL_COUNTERS)])
    return gate(df, signal_rules(), "SIGNAL_AUDIT", ["e"]).withColumn("errors", F.array_join("errors", ","))


def q_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    names = ["gt_locked", "cmac_reset_done", "cmac_tx_ready", "tx_local_fault", "tx_remote_fault", "tx_underflow", "tx_overflow"]
    df = packets(spark, sf_dir).select("e", F.lit(0x00010031).alias("core_version"), *[(e % (7 + k) != 0).cast("int").alias(n) if k < 3 else (e % (7 + k) == 0).cast("int").alias(n) for k, n in enumerate(names)])
    return gate(df, link_rules(), "LINK_PREFLIGHT", ["e"]).withColumn("errors", F.array_join("errors", ","))


def q_packet_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.when(F.col("e") % 5 == 0, "10.0.1.17").when(F.col("e") % 7 != 0, "10.0.1.16")
    rules = packet_rules("10.0.1.16", 4300 + F.col("flow_id"), 1)
    return gate(packets(spark, sf_dir).withColumn("dst_ip", ip), rules, "PACKET", ["e"]).groupBy("classification", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("packets"))


def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    df = packets(spark, sf_dir).select("e", (e % 2).alias("streaming"), F.when(e % 5 == 0, 0).when(e % 5 == 1, 1).alias("downstream_ready"), (e % 7 == 0).cast("int").alias("bridge_full"), (e % 3 == 0).cast("int").alias("mux_locked"), (e % 4).alias("mux_source"))
    return pipeline_state(df).select("e", "accepting", "flush_clean", "stale")


def _nic(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    names = F.array(*map(F.lit, ["rx_discards_phy", "rx_packets", "RX_missed_errors", "prio0_discard", "tx_dropped"]))
    df = packets(spark, sf_dir).withColumn("name", F.get(names, (F.col("e") % 5).cast("int")))
    return df.filter(F.lit(True) if after else F.col("e") % 3 == 0).groupBy("board_id", "name").agg(F.sum((F.col("e") * 31 % 101) - (40 if after else 0)).alias("value"))


def q_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discards(_nic(spark, sf_dir, False), _nic(spark, sf_dir, True))


def q_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counters(spark, sf_dir).withColumns({"healthy": F.dayofmonth("day") % 9 != 3, "drops": F.floor(F.col("packets") / 40)})
    return sustained(c, "board_id", "day", ["packets"], ["drops"])


def q_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("e", F.get(F.array(*map(F.lit, [20, 100, 200])), (F.col("e") % 3).cast("int")).alias("mhz"), (F.col("e") % 2 == 0).alias("aa"), (F.col("e") * 4).alias("sample0"))
    df = df.withColumn("r", first_sample_rule(F.col("mhz"), F.col("aa")))
    return df.select("e", F.col("r.multiple").alias("multiple"), F.col("r.residue").alias("residue"), (F.pmod("sample0", F.col("r.multiple")) == F.col("r.residue")).alias("reachable"))


def q_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards by user: whether all share one rule, and none repeats an id."""
    return common_rule(packets(spark, sf_dir), "user_id", ["time_count", "ninput"], "e")


def q_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of one capture, joined, with the distances of their first samples."""
    p = packets(spark, sf_dir)
    of = lambda keep, less: p.filter(keep).select(F.col("e").alias("k"), (F.col("sample0") - less).alias("sample0"))
    return paired(of("e % 2 = 0", F.lit(0)), of("true", -(F.col("e") % 3)), of("e % 3 = 0", F.col("e") % 5), "k")


def q_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same capture read twice: mismatches by board and the first of them."""
    p = packets(spark, sf_dir)
    b = p.select("e", F.when(F.col("e") % 77 == 5, F.col("block_index") + 1).otherwise(F.col("block_index")).alias("block_index"))
    return compared(p, b, "e", "board_id", "block_index")


def q_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples counted from each board's epoch, its first sample."""
    return rebased(packets(spark, sf_dir), "board_id").select("e", "observation_sample0")


def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of sample numbers by board: steps back, repeats and holes."""
    df = packets(spark, sf_dir).withColumn("s", F.col("sample0") - F.when(F.col("e") % 31 == 0, 40_000).otherwise(0))
    return order_audit(df, "board_id", ["ts", "e"], "s", 2048)


QUERIES = {
    "host_gate": q_host, "board_gate": q_board, "science_gate": q_science, "signal_audit": q_signal, "link_preflight": q_link, "packet_expectation": q_packet_expectation, "pipeline_health": q_health, "nic_discards": q_discards, "sustained_progress": q_sustained,
    "alignment_rule": q_alignment, "board_consistency": q_boards, "provenance_pairing": q_pairing, "readback_identity": q_identity, "sample0_rebase": q_rebase, "sample0_audit": q_audit,
}


def _gate_sql(rules: list[tuple[str, str]], name: str, source: str) -> str:
    codes = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules)
    return f"SELECT e, CASE WHEN errors = '' THEN '{name}_PASS' ELSE '{name}_FAIL' END AS classification, errors = '' AS ok, errors FROM (SELECT e, concat_ws(',', {codes}) AS errors FROM ({source}))"


_HOST = """SELECT *, atf + asp AS af, atf + asp - CASE WHEN e % 70 = 5 THEN 1 ELSE 0 END AS aw FROM (SELECT *, CASE WHEN t THEN n - e % 7 * 30000 ELSE 0 END AS tp, CASE WHEN s THEN n - e % 5 * 30000 WHEN e % 50 = 1 THEN 1 ELSE 0 END AS sp, CASE WHEN t THEN 8 ELSE 0 END AS atf, CASE WHEN s THEN 16 WHEN e % 40 = 3 THEN 1 ELSE 0 END AS asp,
    CASE WHEN t THEN 8 ELSE 0 END AS wt, CASE WHEN s THEN 16 ELSE 0 END AS ws FROM (SELECT e, CASE WHEN e % 3 = 0 THEN 200 ELSE 100 END AS mhz, CASE WHEN e % 3 = 0 THEN 9600000 ELSE 4800000 END AS n, (e // 3) % 3 <> 1 AS t, (e // 3) % 3 <> 0 AS s FROM packets))"""
_HOST_RULES = [
    ("TIME_FLOW_COUNT_MISMATCH", "atf <> wt"), ("SPEC_FLOW_COUNT_MISMATCH", "asp <> ws"), ("FLOW_COUNT_MISMATCH", "af <> wt + ws"), ("CAPTURE_FLOW_CAPACITY_MISMATCH", "e % 60 = 2"), ("ACTIVE_WORKERS_LOW", "aw < wt + ws"),
    ("TIME_PPS_LOW", "t AND tp / 10 < CASE WHEN mhz = 100 THEN 470000 ELSE 950000 END"), ("SPEC_PPS_LOW", "s AND sp / 10 < CASE WHEN mhz = 100 THEN 470000 ELSE 950000 END"), ("TIME_PACKETS_IN_SPEC_ONLY", "NOT t AND tp <> 0"), ("SPEC_PACKETS_IN_TIME_ONLY", "NOT s AND sp <> 0"),
    ("COMBINED_PAYLOAD_RATE_LOW", "(tp + sp) * 8320 * 8 / 10 / 1e6 < CASE WHEN mhz = 200 OR (t AND s) THEN 63000 ELSE 31000 END"), *[(f"NONZERO_{c.upper()}", f"e % {90 + k} = 7") for k, c in enumerate(HOST_COUNTERS)],
]
_AFTER_RULES = [
    ("WAVEFORM_PREVIEW_NOT_LIVE", "t AND (e % 21 = 8 OR e % 22 = 9)"), ("SPECTRUM_PREVIEW_NOT_LIVE", "s AND e % 23 = 8"), ("SPEC_PREVIEW_INCOMPLETE", "s AND (e % 33 = 4 OR e % 31 = 6)"),
    *[(f"NIC_{c.upper()}", f"e % {110 + k} = 8") for k, c in enumerate(NIC_COUNTERS)], ("NIC_PHYSICAL_DISCARD", "e % 120 = 9"),
]
_FLOW_RULES = [("MISSING", "on_ AND gone"), ("NO_PACKETS", "on_ AND NOT gone AND quiet"), *[(c.upper(), f"on_ AND NOT gone AND (e + f) % {503 + 2 * k} = 11") for k, c in enumerate(FLOW_COUNTERS)], ("INACTIVE_PACKETS", "NOT on_ AND NOT quiet AND (e + f) % 307 = 5")]
_T, _S = "mode = 'time_only'", "mode = 'spec_only'"
_LOW = "printf('%.3f', {})"
# (code as SQL, condition) over the status columns
_BOARD_SQL = [
    ("'WRONG_CORE_VERSION expected 0x00010031 got 0x' || printf('%08x', core_version)", "core_version <> 65585"), ("'WRONG_CLOCK_REF'", "clock_ref <> 0"), ("'WRONG_SYNC_MODE'", "configured_sync_mode <> 0 OR active_sync_mode <> 0"), ("'EXTERNAL_PPS_NOT_READY'", "pps_recent = 0 OR pps_count <= 0"),
    ("'DIAGNOSTIC_INJECTION_ENABLED'", "diag_control <> 65280"), ("'SCIENCE_BANDWIDTH_MISMATCH'", "science_mhz <> 100"), ("'TIME_ENABLE_MISMATCH'", f"(time_enabled = 1) <> ({_T})"), ("'SPEC_ENABLE_MISMATCH'", f"(spec_enabled = 1) <> ({_S})"), ("'SCIENCE_100MHZ_ANTIALIAS_NOT_READY'", "aa_active = 0 OR aa_primed = 0"),
    ("'SCIENCE_100MHZ_ANTIALIAS_CONTRACT_MISMATCH'", "aa_taps <> 41 OR aa_coeff_version <> 2853175361"), ("'CMAC_LIVE_TX_NOT_ENABLED'", "udp_dry_run_active <> 0 OR cmac_enable = 0"), *[(f"'NONZERO_{c.upper()}'", f"{c} <> 0") for c in BOARD_COUNTERS],
    ("'SPEC_PACKETS_PRESENT_IN_TIME_ONLY'", f"{_T} AND spec_packet_count <> 0"), ("'TIME_PACKETS_PRESENT_IN_SPEC_ONLY'", f"{_S} AND time_packet_count <> 0"),
    ("'TIME_PPS_LOW ' || " + _LOW.format("time_packet_count / elapsed") + " || ' < 470000'", f"{_T} AND time_packet_count / elapsed < 470000"), ("'SPEC_PPS_LOW ' || " + _LOW.format("spec_packet_count / elapsed") + " || ' < 470000'", f"{_S} AND spec_packet_count / elapsed < 470000"),
    ("'COMBINED_PAYLOAD_LOW ' || " + _LOW.format("(time_packet_count + spec_packet_count) * 8320 * 8 / elapsed / 1e6") + " || ' < 31000'", "(time_packet_count + spec_packet_count) * 8320 * 8 / elapsed / 1e6 < 31000"),
    ("'TIME_ROUTE_CONTRACT_FAILED'", f"{_T} AND (time_routes <> 8 OR time_routes_hit < time_routes)"), ("'TIME_ROUTE_ENABLED_IN_SPEC_ONLY'", f"NOT {_T} AND time_routes <> 0"), ("'SPEC_ROUTE_CONTRACT_FAILED'", f"{_S} AND (spec_routes <> 16 OR spec_routes_hit < spec_routes)"),
    ("'FENGINE_SCIENCE_NOT_VALID'", f"{_S} AND fengine_science_valid = 0"), ("'PFB_TAPS_NOT_4'", f"{_S} AND pfb_taps <> 4"), ("'PFB_NOT_ACTIVE'", f"{_S} AND pfb_active = 0"), ("'PFB_COEFF_NOT_VALID'", f"{_S} AND pfb_coeff_active_valid = 0"), ("'PFB_CHAN_COUNT_NOT_256'", f"{_S} AND pfb_chan_count <> 256"),
    ("'PFB_TIME_COUNT_NOT_1'", f"{_S} AND pfb_time_count <> 1"), ("'SPEC_ROUTE_ENABLED_IN_TIME_ONLY'", f"NOT {_S} AND spec_routes <> 0"), ("'PFB_ACTIVE_IN_TIME_ONLY'", f"NOT {_S} AND pfb_active <> 0"),
]
_TT, _SS = "mode <> 'spec_only'", "mode <> 'time_only'"
_SCIENCE_SQL = [
    ("'WRONG_CORE_VERSION expected 0x00010025 got 0x' || printf('%08x', core_version)", "core_version <> 65573"), ("'TX_STILL_DRY_RUN'", "udp_dry_run_active <> 0"), ("'CMAC_TX_NOT_ENABLED'", "cmac_enable = 0"), ("'FRAME_BUILDER_NOT_ENABLED'", "frame_builder_enabled = 0"), ("'CMAC_TX_UNDERFLOW'", "tx_underflow <> 0"), ("'CMAC_TX_OVERFLOW'", "tx_overflow <> 0"),
    ("'FENGINE_SCIENCE_NOT_VALID'", "fengine_science_valid = 0"), ("'PFB_FFT_NOT_READY'", f"{_SS} AND pfb_fft_not_ready <> 0"), ("'FENGINE_OVERFLOW'", f"{_SS} AND pfb_overflow_count <> 0"), ("'FENGINE_XFFT_EVENT'", f"{_SS} AND pfb_xfft_event_count <> 0"), ("'FENGINE_TILE_OVERFLOW'", f"{_SS} AND pfb_tile_overflow_count <> 0"), ("'SPEC_ROUTE_INCOMPLETE'", f"{_SS} AND spec_route_incomplete <> 0"),
    ("'SCIENCE_RATE_DROPPED'", "science_dropped_beat_count <> 0"), ("'RFDC_DROPPED'", "rfdc_dropped_count <> 0"), ("'SCIENCE_OUTPUT_MODE_MISMATCH'", "output_mode <> mode"), ("'TIME_PACKET_COUNTER_NOT_INCREMENTING'", f"{_TT} AND time_packet_count < 1"), ("'TIME_DROPPED'", f"{_TT} AND time_dropped_count <> 0"), ("'SPEC_PACKET_COUNTER_NOT_INCREMENTING'", f"{_SS} AND spec_packet_count < 1"),
    ("'SPEC_DROPPED'", f"{_SS} AND spec_dropped_count <> 0"), ("'TX_FRAME_COUNTER_NOT_INCREMENTING'", "tx_frame_built_count < 1"), ("'TX_ROUTE_MISS'", "tx_route_miss_count <> 0"), ("'TX_ROUTE_ERROR'", "tx_route_error_count <> 0"), ("'TX_FRAME_DROPPED'", "tx_frame_dropped_count <> 0"), ("'SPEC_ROUTE_COVERAGE_INCOMPLETE'", f"{_SS} AND spec_routes_hit < 64"),
    ("'SPEC_ROUTE_CHAN_COUNT_BAD'", f"{_SS} AND spec_routes_odd_count <> 0"), ("'SPEC_ROUTE_ENDPOINT_RANGE_BAD'", f"{_SS} AND spec_routes_odd_endpoint <> 0"), ("'SPEC_ROUTE_HITS_MISSING'", f"{_SS} AND spec_routes_unhit <> 0"),
]
_LINK_SQL = [("'GT_NOT_LOCKED'", "gt_locked = 0"), ("'CMAC_RESET_NOT_DONE'", "cmac_reset_done = 0"), ("'CMAC_TX_NOT_READY'", "cmac_tx_ready = 0")]


def _transmitter_sql(status: dict[str, str], rules: list[tuple[str, str]], blockers: list[tuple[str, str]], name: str) -> str:
    said = lambda x: "concat_ws(',', " + ", ".join(f"CASE WHEN {bad} THEN {code} END" for code, bad in x) + ")"
    return sql("packets", f"""SELECT e, '{name}_' || mhz || 'MHZ_' || mode || CASE WHEN errors = '' AND blockers = '' THEN '_PASS' ELSE '_FAIL' END AS classification, errors = '' AND blockers = '' AS ok, errors, blockers, round(time_packet_count / elapsed, 6) AS time_pps, round(spec_packet_count / elapsed, 6) AS spec_pps,
        round((time_packet_count + spec_packet_count) * 8320 * 8 / elapsed / 1e6, 6) AS payload_mbps FROM (SELECT *, {said(rules)} AS errors, {said(blockers)} AS blockers FROM (SELECT e, {", ".join(f"{x} AS {c}" for c, x in status.items())} FROM packets))""")


_SIGNAL_RULES = [("WRONG_CORE_VERSION", "e % 41 = 0"), ("DIAGNOSTIC_INJECTION_ENABLED", "e % 43 = 0"), *[(f"NONZERO_{c.upper()}", f"e % {50 + k} = 3") for k, c in enumerate(SIGNAL_COUNTERS)], ("AA100_NOT_READY", "e % 2 = 0 AND (e % 5 = 1 OR e % 6 = 2)"), ("AA100_ACTIVE_AT_200MHZ", "e % 2 = 1 AND e % 5 <> 1")]
_LINK_RULES = [(c, f"e % {7 + k} = 0") for k, c in enumerate(["GT_NOT_LOCKED", "CMAC_RESET_NOT_DONE", "CMAC_TX_NOT_READY", "CMAC_LOCAL_FAULT", "CMAC_REMOTE_FAULT", "CMAC_TX_UNDERFLOW", "CMAC_TX_OVERFLOW"])]
_NIC = "SELECT board_id, ['rx_discards_phy', 'rx_packets', 'RX_missed_errors', 'prio0_discard', 'tx_dropped'][e % 5 + 1] AS name, sum(e * 31 % 101 - {})::BIGINT AS v FROM packets WHERE {} GROUP BY 1, 2"
SQL = {
    "host_gate": sql("packets", "").strip() + f""", h AS ({_HOST}), g AS (SELECT *, CASE WHEN t AND s THEN 'time_spec' WHEN t THEN 'time_only' ELSE 'spec_only' END AS mode FROM h),
        x AS (SELECT e, f, CASE WHEN f < 8 THEN t ELSE s END AS on_, (e + f) % 401 = 7 AS gone, (e + f) % 211 = 3 AS quiet FROM h, (SELECT unnest(range(24)) AS f)),
        y AS (SELECT e, on_, f, concat_ws(',', {", ".join(f"CASE WHEN {bad} THEN 'FLOW_' || f || '_{code}' END" for code, bad in _FLOW_RULES)}) AS said FROM x), z AS (SELECT e, string_agg(said, ',' ORDER BY NOT on_, f) AS flows FROM y WHERE said <> '' GROUP BY e),
        r AS (SELECT e, mhz, mode, concat_ws(',', {", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in _HOST_RULES)}, flows, {", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in _AFTER_RULES)}) AS errors FROM g LEFT JOIN z USING (e))
        SELECT e, 'HOST_' || mhz || 'MHZ_' || mode || CASE WHEN errors = '' THEN '_PASS' ELSE '_FAIL' END AS classification, errors = '' AS ok, errors FROM r""",
    "board_gate": _transmitter_sql(_STATUS, _BOARD_SQL, [*_LINK_SQL, ("'CMAC_FAULT'", "tx_local_fault <> 0 OR tx_remote_fault <> 0")], "BOARD"),
    "science_gate": _transmitter_sql(_SCIENCE, _SCIENCE_SQL, [*_LINK_SQL, ("'CMAC_LOCAL_FAULT'", "tx_local_fault <> 0"), ("'CMAC_REMOTE_FAULT'", "tx_remote_fault <> 0")], "SCIENCE"),
    "signal_audit": sql("packets", _gate_sql(_SIGNAL_RULES, "SIGNAL_AUDIT", "SELECT e FROM packets")),
    "link_preflight": sql("packets", _gate_sql(_LINK_RULES, "LINK_PREFLIGHT", "SELECT e FROM packets")),
    "packet_expectation": sql("packets", "SELECT CASE WHEN errors = '' THEN 'PACKET_PASS' ELSE 'PACKET_FAIL' END AS classification, errors, count(*) AS packets FROM (SELECT concat_ws(',', CASE WHEN e % 5 = 0 OR e % 7 = 0 THEN 'DST_IP' END, CASE WHEN dst_port <> 4300 + flow_id THEN 'DST_PORT' END, CASE WHEN stream_type <> 1 THEN 'STREAM' END) AS errors FROM packets) GROUP BY errors"),
    "pipeline_health": sql("packets", "SELECT e, e % 2 = 1 AND e % 5 <> 0 AND e % 7 <> 0 AS accepting, e % 5 <> 0 AND e % 7 <> 0 AND NOT (e % 3 = 0 AND e % 4 IN (1, 2)) AS flush_clean, e % 3 = 0 AND e % 4 IN (1, 2) AS stale FROM packets"),
    "nic_discards": sql("packets", f"SELECT coalesce(a.board_id, b.board_id) AS board_id, sum(greatest(coalesce(a.v, 0) - coalesce(b.v, 0), 0))::BIGINT AS discards FROM ({_NIC.format(40, 'true')}) a FULL JOIN ({_NIC.format(0, 'e % 3 = 0')}) b USING (board_id, name) WHERE regexp_matches(coalesce(a.name, b.name), '(?i)rx.*(discard|drop|miss|error)|prio.*discard') GROUP BY 1"),
    "sustained_progress": sql("counters", "SELECT board_id, min(day) FILTER (h AND ph AND packets > pp AND packets // 40 = pp // 40) AS since FROM (SELECT *, dayofmonth(day) % 9 <> 3 AS h, lag(dayofmonth(day) % 9 <> 3) OVER w AS ph, lag(packets) OVER w AS pp FROM counters WINDOW w AS (PARTITION BY board_id ORDER BY day)) GROUP BY board_id"),
    "alignment_rule": sql("packets", "SELECT e, m::INTEGER AS multiple, r::INTEGER AS residue, e * 4 % m = r AS reachable FROM (SELECT e, [32, 8, 4][e % 3 + 1] AS m, CASE WHEN e % 3 = 1 AND e % 2 = 0 THEN 4 ELSE 0 END AS r FROM packets)"),
    "board_consistency": sql("packets", "SELECT user_id, count(DISTINCT (time_count, ninput)) = 1 AS common_rule, count(DISTINCT e) = count(*) AS unique_ids FROM packets GROUP BY user_id"),
    "provenance_pairing": sql("packets", "SELECT e AS k, e % 3 AS preview_delta, -(e % 5) AS header_delta, e % 3 = 0 AND e % 5 = 0 AS coherent FROM packets WHERE e % 6 = 0"),
    "readback_identity": sql("packets", "SELECT board_id, count(*) AS compared, count(*) FILTER (e % 77 = 5) AS mismatches, min(e) FILTER (e % 77 = 5) AS first FROM packets GROUP BY board_id"),
    "sample0_rebase": sql("packets", "SELECT e, sample0 - min(sample0) OVER (PARTITION BY board_id) AS observation_sample0 FROM packets"),
    "sample0_audit": sql("packets", "SELECT board_id, count(*) FILTER (d < 0) AS back, count(*) FILTER (d = 0) AS repeats, count(*) FILTER (d > 2048) AS holes FROM (SELECT board_id, s - lag(s) OVER (PARTITION BY board_id ORDER BY ts, e) AS d FROM (SELECT *, sample0 - CASE WHEN e % 31 = 0 THEN 40000 ELSE 0 END AS s FROM packets)) GROUP BY board_id"),
}
