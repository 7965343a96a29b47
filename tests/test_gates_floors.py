"""The transmitter's gate at its floors, and what blocks apart from errors."""

import pytest

from fluxframe.operators import gates

GOOD = {
    "mhz": 100, "mode": "time_only", "elapsed": 10.0, "core_version": 0x00010031, "clock_ref": 0, "configured_sync_mode": 0, "active_sync_mode": 0, "pps_recent": 1, "pps_count": 5, "diag_control": 0xFF00, "science_mhz": 100, "time_enabled": 1, "spec_enabled": 0, "aa_active": 1, "aa_primed": 1,
    "aa_taps": 41, "aa_coeff_version": 0xAA100041, "gt_locked": 1, "cmac_reset_done": 1, "cmac_tx_ready": 1, "tx_local_fault": 0, "tx_remote_fault": 0, "udp_dry_run_active": 0, "cmac_enable": 1, "fengine_science_valid": 0, "pfb_taps": 0, "pfb_active": 0, "pfb_coeff_active_valid": 0,
    "pfb_chan_count": 0, "pfb_time_count": 0, "time_packet_count": 4_800_000, "spec_packet_count": 0, "time_routes": 8, "time_routes_hit": 8, "spec_routes": 0, "spec_routes_hit": 0, **dict.fromkeys(gates.BOARD_COUNTERS, 0),
}
SPEC = {"mode": "spec_only", "time_enabled": 0, "spec_enabled": 1, "time_packet_count": 0, "spec_packet_count": 4_800_000, "time_routes": 0, "time_routes_hit": 0, "spec_routes": 16, "spec_routes_hit": 16, "fengine_science_valid": 1, "pfb_taps": 4, "pfb_active": 1, "pfb_coeff_active_valid": 1, "pfb_chan_count": 256, "pfb_time_count": 1}

CASES = [
    ({}, [], []),
    ({"time_packet_count": 4_720_000}, [], []),  # 472,000 a second is enough
    ({"time_packet_count": 4_700_000}, [], []),
    ({"time_packet_count": 4_699_999}, ["TIME_PPS_LOW 469999.900 < 470000"], []),
    ({"time_packet_count": 4_650_000}, ["TIME_PPS_LOW 465000.000 < 470000", "COMBINED_PAYLOAD_LOW 30950.400 < 31000"], []),
    ({"spec_packet_count": 1}, ["SPEC_PACKETS_PRESENT_IN_TIME_ONLY"], []),
    ({"core_version": 0x00010030, "clock_ref": 1, "active_sync_mode": 2}, ["WRONG_CORE_VERSION expected 0x00010031 got 0x00010030", "WRONG_CLOCK_REF", "WRONG_SYNC_MODE"], []),
    ({"aa_primed": 0, "aa_taps": 40}, ["SCIENCE_100MHZ_ANTIALIAS_NOT_READY", "SCIENCE_100MHZ_ANTIALIAS_CONTRACT_MISMATCH"], []),
    ({"gt_locked": 0, "tx_remote_fault": 1}, [], ["GT_NOT_LOCKED", "CMAC_FAULT"]),
    ({"udp_dry_run_active": 1, "pfb_active": 1}, ["CMAC_LIVE_TX_NOT_ENABLED", "PFB_ACTIVE_IN_TIME_ONLY"], []),
    (SPEC, [], []),
    (SPEC | {"pfb_taps": 3, "pfb_chan_count": 64, "fengine_science_valid": 0}, ["FENGINE_SCIENCE_NOT_VALID", "PFB_TAPS_NOT_4", "PFB_CHAN_COUNT_NOT_256"], []),
    (SPEC | {"spec_routes_hit": 15, "time_routes": 1, "tx_route_miss_count": 2}, ["NONZERO_TX_ROUTE_MISS_COUNT", "TIME_ROUTE_ENABLED_IN_SPEC_ONLY", "SPEC_ROUTE_CONTRACT_FAILED"], []),
    ({"pps_recent": None, "gt_locked": None, "diag_control": None}, ["EXTERNAL_PPS_NOT_READY", "DIAGNOSTIC_INJECTION_ENABLED"], ["GT_NOT_LOCKED"]),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [{"k": k, **GOOD, **change} for k, (change, _, _) in enumerate(CASES)]
    schema = ", ".join(f"{c} {'string' if c == 'mode' else 'double' if c == 'elapsed' else 'long'}" for c in rows[0])
    df = spark.createDataFrame([tuple(r[c] for c in rows[0]) for r in rows], schema)
    return {r.k: r for r in gates.transmitter_gate(df, gates.board_rules(), gates.link_blockers(), "BOARD", ["k"]).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_board_gate(judged, k):
    change, errors, blockers = CASES[k]
    got = judged[k]
    assert (got.errors, got.blockers) == (errors, blockers)
    mode = change.get("mode", "time_only")
    assert got.ok == (not errors and not blockers) and got.classification == f"BOARD_100MHZ_{mode}_{'PASS' if got.ok else 'FAIL'}"
