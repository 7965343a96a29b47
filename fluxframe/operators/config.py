"""Configurations and requests as rows: addresses, profiles, bands, endpoints and channels checked by rules as data; display
settings brought into range; status words unpacked; names and fallbacks.

A configuration is a row with bandwidth_mhz, mode, center_mhz, board_id, source_ip, source_mac, endpoints (array of ENDPOINT)
and channels (array of CHANNEL). configuration_errors() names every rule that fails, request_error() the first one, in the order
in which the board's agent checks. A null breaks the rule that needs the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.functions.bits import bit
from fluxframe.operators.gates import Rules, failed
from fluxframe.operators.validate import first_of
from fluxframe.plans.views import packets, sql

ENDPOINT = "endpoint_id int, stream string, enabled boolean, ip string, mac string, source_port int, destination_port int"
CHANNEL = "channel int, enabled boolean, rf_frequency_mhz double, amplitude_percent double, phase_deg double"
# The allowed profiles (bandwidth in MHz, mode), and how many endpoints each stream has.
PROFILES = ((100, "time_only"), (100, "spec_only"), (100, "time_spec"), (200, "time_only"), (200, "spec_only"))
TIME_ENDPOINTS, SPEC_ENDPOINTS, CHANNELS = 8, 16, 8
# The science band in MHz, half of the sampled band by bandwidth, and short names of modes.
LOW_MHZ, HIGH_MHZ = 50.0, 350.0
HALF_BAND_MHZ = {100: 61.44, 200: 122.88}
MODE_NAMES = {"time": "time_only", "spec": "spec_only", "dual": "time_spec"}
# Flags of the status word, from bit 0.
STATUS_FLAGS = ("time_valid", "pps_locked", "ref_locked", "rfdc_ready", "streaming", "fifo_overflow")
# What a live snapshot must and must not show to be taken for the stored one's link columns, and these columns.
LIVE_TRUE = ("gt_locked", "cmac_reset_done", "cmac_tx_ready", "qsfp_link_up", "cmac_enable", "frame_builder_enabled")
LIVE_FALSE = ("udp_dry_run_active", "tx_local_fault", "tx_remote_fault")
LIVE_COLUMNS = (*LIVE_TRUE, *LIVE_FALSE, "tx_underflow", "tx_overflow")


def mode_name(text: Column) -> Column:
    """time_only, spec_only or time_spec of a mode as people write it, else null."""
    key = F.regexp_replace(F.lower(F.trim(text)), "[- ]", "_")
    out = F.when(key.isin(*MODE_NAMES.values()), key)
    for short, name in MODE_NAMES.items():
        out = out.when(key == short, name)
    return out


def ipv4_number(text: Column) -> Column:
    """The address as a number; null unless it is four numbers up to 255 without leading zeros."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    trimmed = F.trim(text)
    pattern = "^" + r"\.".join([octet] * 4) + "$"
    part = [F.regexp_extract(trimmed, pattern, k + 1).try_cast("long") for k in range(4)]
    return ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]


def is_unicast_ip(text: Column) -> Column:
    n = ipv4_number(text)
    return F.coalesce((n != 0) & (n != 0xFFFFFFFF) & ~n.between(0xE0000000, 0xEFFFFFFF), F.lit(False))


def mac_hex(text: Column) -> Column:
    """A MAC address as 12 lower-case digits; null unless it is six pairs with colons."""
    x = F.lower(F.trim(text))
    return F.when(x.rlike("^([0-9a-f]{2}:){5}[0-9a-f]{2}$"), F.replace(x, F.lit(":"), F.lit("")))


def is_unicast_mac(text: Column) -> Column:
    x = mac_hex(text)
    return F.coalesce((x != "0" * 12) & (F.conv(F.substring(x, 2, 1), 16, 10).cast("int") % 2 == 0), F.lit(False))


def _within(x: Column, low: float, high: float) -> Column:
    """Finite and in range; NaN is greater than all numbers, so it is out."""
    return F.coalesce(x.between(low, high), F.lit(False))


def is_profile(mhz: Column, mode: Column) -> Column:
    return F.coalesce(F.concat_ws("/", mhz.cast("string"), mode).isin(*(f"{b}/{m}" for b, m in PROFILES)), F.lit(False))


def _every(array: Column, good) -> Column:
    return F.coalesce(F.forall(array, good), F.lit(False))


def band_mhz(mhz: Column, center: Column) -> tuple[Column, Column]:
    half = F.when(mhz == 100, HALF_BAND_MHZ[100]).otherwise(HALF_BAND_MHZ[200])
    return center - half, center + half


def configuration_rules() -> Rules:
    mode = mode_name(F.col("mode"))
    of = lambda stream: F.filter("endpoints", lambda e: e["stream"] == stream)
    low, high = band_mhz(F.col("bandwidth_mhz"), F.col("center_mhz"))
    port = lambda c: lambda e: e[c].between(1, 65535)
    not_ = lambda good: ~F.coalesce(good, F.lit(False))
    return [
        ("MODE", mode.isNull()),
        ("PROFILE", ~is_profile(F.col("bandwidth_mhz"), mode)),
        ("CENTER", ~_within(F.col("center_mhz"), LOW_MHZ, HIGH_MHZ)),
        ("BOARD_ID", not_(F.col("board_id").between(0, 65535))),
        ("SOURCE_IP", ~is_unicast_ip(F.col("source_ip"))),
        ("SOURCE_MAC", ~is_unicast_mac(F.col("source_mac"))),
        ("TIME_ENDPOINTS", not_(F.size(of("TIME")) == TIME_ENDPOINTS)),
        ("SPEC_ENDPOINTS", not_(F.size(of("SPEC")) == SPEC_ENDPOINTS)),
        ("DESTINATION_IP", ~_every(F.col("endpoints"), lambda e: ipv4_number(e["ip"]).isNotNull())),
        ("DESTINATION_MAC", ~_every(F.col("endpoints"), lambda e: mac_hex(e["mac"]).isNotNull())),
        ("DESTINATION_PORT", ~_every(F.col("endpoints"), port("destination_port"))),
        ("SOURCE_PORT", ~_every(F.col("endpoints"), port("source_port"))),
        ("CHANNELS", not_(F.size("channels") == CHANNELS)),
        ("FREQUENCY", ~_every(F.col("channels"), lambda c: _within(c["rf_frequency_mhz"], LOW_MHZ, HIGH_MHZ))),
        ("AMPLITUDE", ~_every(F.col("channels"), lambda c: _within(c["amplitude_percent"], 0, 100))),
        ("PHASE", ~_every(F.col("channels"), lambda c: _within(c["phase_deg"], -180, 180))),
        ("NYQUIST_BAND", ~_every(F.col("channels"), lambda c: c["rf_frequency_mhz"].between(low, high))),
    ]


def configuration_errors(df: DataFrame) -> DataFrame:
    """df with errors, the rules that its configuration breaks, in order."""
    return df.withColumn("errors", failed(configuration_rules()))


def configured(df: DataFrame) -> DataFrame:
    """Configurations as they are applied; a row that breaks a rule raises, and names the rules."""
    out = configuration_errors(df)
    bad = F.raise_error(F.concat(F.lit("configuration: "), F.array_join("errors", ", "))).cast("string")
    mode = F.when(F.size("errors") > 0, bad).otherwise(mode_name(F.col("mode")))
    return out.withColumns({"mode": mode, "source_ip": F.trim("source_ip"), "source_mac": F.lower(F.trim("source_mac"))}).drop("errors")


def request_error(df: DataFrame) -> DataFrame:
    """df with error, the first rule that a configure request breaks, or null: endpoints are checked one after another."""
    def endpoint_error(e: Column, k: Column) -> Column:
        seen = F.exists(F.slice(F.col("endpoints"), F.lit(1), k), lambda x: x["endpoint_id"] == e["endpoint_id"])
        return first_of(
            (F.coalesce(~e["endpoint_id"].between(0, TIME_ENDPOINTS + SPEC_ENDPOINTS - 1) | seen, F.lit(True)), "ENDPOINT_ID"),
            (F.coalesce(e["stream"] != F.when(e["endpoint_id"] < TIME_ENDPOINTS, "TIME").otherwise("SPEC"), F.lit(True)), "ENDPOINT_STREAM"),
            (~is_unicast_ip(e["ip"]), "ENDPOINT_IP"),
            (~is_unicast_mac(e["mac"]), "ENDPOINT_MAC"),
            (F.coalesce(~e["source_port"].between(1, 65535) | ~e["destination_port"].between(1, 65535), F.lit(True)), "ENDPOINT_PORT"),
        )

    bad = F.get(F.array_compact(F.transform("endpoints", endpoint_error)), F.lit(0))
    on = lambda stream: F.exists("endpoints", lambda e: e["enabled"] & (e["stream"] == stream))
    wants = {m: (on("TIME") if m != "spec_only" else ~on("TIME")) & (on("SPEC") if m != "time_only" else ~on("SPEC")) for m in MODE_NAMES.values()}
    mask = F.coalesce(*[F.when(F.col("mode") == m, ok) for m, ok in wants.items()], F.lit(False))
    first = first_of(
        (~is_profile(F.col("bandwidth_mhz"), F.col("mode")), "PROFILE"),
        (~_within(F.col("center_mhz"), LOW_MHZ, HIGH_MHZ), "CENTER"),
        (~is_unicast_ip(F.col("source_ip")), "SOURCE_IP"),
        (~is_unicast_mac(F.col("source_mac")), "SOURCE_MAC"),
        (~F.coalesce(F.size("endpoints") == TIME_ENDPOINTS + SPEC_ENDPOINTS, F.lit(False)), "ENDPOINT_COUNT"),
    )
    return df.withColumn("error", F.coalesce(first, bad, F.when(~mask, "ENABLE_MASK")))


def channels_error(df: DataFrame) -> DataFrame:
    """df (center_mhz, channels) with error, the first rule that a request for the converters breaks, or null."""
    def channel_error(c: Column, k: Column) -> Column:
        seen = F.exists(F.slice(F.col("channels"), F.lit(1), k), lambda x: x["channel"] == c["channel"])
        return first_of(
            (F.coalesce(~c["channel"].between(0, CHANNELS - 1) | seen, F.lit(True)), "CHANNEL_ID"),
            (~_within(c["rf_frequency_mhz"], LOW_MHZ, HIGH_MHZ), "FREQUENCY"),
            (~_within(c["amplitude_percent"], 0, 100), "AMPLITUDE"),
            (~_within(c["phase_deg"], -180, 180), "PHASE"),
        )

    first = first_of((~_within(F.col("center_mhz"), LOW_MHZ, HIGH_MHZ), "CENTER"), (~F.coalesce(F.size("channels") == CHANNELS, F.lit(False)), "CHANNEL_COUNT"))
    return df.withColumn("error", F.coalesce(first, F.get(F.array_compact(F.transform("channels", channel_error)), F.lit(0))))


def start_error(df: DataFrame) -> DataFrame:
    """df (generation, target_pps, epoch_tai, first_sample0 or null, mts_result_id, signal_chain_tag) with error, the first rule
    that a request for a scheduled start breaks, or null."""
    none = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    return df.withColumn("error", first_of(
        (none("generation"), "GENERATION"), (none("target_pps"), "TARGET_PPS"), (none("epoch_tai"), "EPOCH_TAI"),
        (F.coalesce((F.col("first_sample0") == 0) | (F.col("first_sample0") % 4 != 0), F.lit(False)), "FIRST_SAMPLE0"),
        (none("mts_result_id"), "MTS_RESULT"), (none("signal_chain_tag"), "SIGNAL_CHAIN"),
    ))


def sanitised(df: DataFrame) -> DataFrame:
    """df with its display settings brought into range, never refused: bandwidth (else 100), output mode (else time_spec),
    points 64 to 16384, view (else dual), window 0.02 to 25 us, scale 1 to a million, mask of eight channels (of none, the
    first), and each channel's target, which if not finite or out of range is the expected, else the converter's, else the
    centre frequency."""
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))
    positive = lambda c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    mask = F.col("channel_mask").bitwiseAND(F.lit(255))
    target = F.coalesce(positive("expected_mhz"), positive("dac_mhz"), F.col("center_mhz"))
    return df.withColumns({
        "bandwidth_mhz": F.when(F.col("bandwidth_mhz").isin(20, 100, 200), F.col("bandwidth_mhz")).otherwise(100),
        "output_mode": F.when(F.col("output_mode").isin(*MODE_NAMES.values()), F.col("output_mode")).otherwise("time_spec"),
        "display_points": clip("display_points", 64, 16384),
        "view_mode": F.when(F.col("view_mode").isin("dual", "samples", "curve"), F.col("view_mode")).otherwise("dual"),
        "time_window_us": clip("time_window_us", 0.02, 25.0),
        "vertical_scale": clip("vertical_scale", 1.0, 1e6),
        "channel_mask": F.when(mask == 0, 1).otherwise(mask),
        "target_mhz": F.transform("target_mhz", lambda t: F.when(_within(t, 0.0, 100_000.0), t).otherwise(target)),
    })


def unpacked_status(df: DataFrame, word: str, flags: tuple[str, ...] = STATUS_FLAGS) -> DataFrame:
    """df with a boolean column for each flag of a status word."""
    return df.withColumns({n: bit(F.col(word), k) == 1 for k, n in enumerate(flags)})


def profile_name(name: Column, code: Column, names: dict[int, str]) -> Column:
    """A profile's name as told, else by its code, else unknown."""
    by_code = F.lit(None).cast("string")
    for k, n in names.items():
        by_code = F.when(code == k, n).otherwise(by_code)
    return F.coalesce(name, by_code, F.lit("unknown"))


def with_fallback(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with each column taken from its alternative where it is null or 0."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(other)) for c, other in columns.items()})


def with_live_link(df: DataFrame, prefix: str = "live_") -> DataFrame:
    """df's link columns taken from its live ones (the same names with prefix) where these make sense together: all that must
    show do, and none that must not does; a missing one counts against it. source says which were taken."""
    live = lambda c: F.coalesce(F.col(prefix + c), F.lit(1 if c == "udp_dry_run_active" else 0)) != 0
    ready = F.lit(True)
    for c in LIVE_TRUE:
        ready &= live(c)
    for c in LIVE_FALSE:
        ready &= ~live(c)
    out = {c: F.when(ready, F.coalesce(F.col(prefix + c), F.col(c))).otherwise(F.col(c)) for c in LIVE_COLUMNS}
    return df.withColumns(out | {"source": F.when(ready, "live").otherwise("snapshot")}).drop(*(prefix + c for c in LIVE_COLUMNS))


def phases_by_channel(given: Column, offset_deg: Column, step_deg: Column, count: int = 8) -> Column:
    """Each channel's phase from a map by channel, and for those without one offset + step * channel."""
    return F.array(*[F.coalesce(F.try_element_at(given, F.lit(k)), offset_deg + step_deg * k) for k in range(count)])


def phases_of_list(given: Column, offset_deg: Column, step_deg: Column, count: int = 8) -> Column:
    """The same from an array of the first channels' phases; a longer one than count raises."""
    out = F.array(*[F.coalesce(F.get(given, F.lit(k)), offset_deg + step_deg * k) for k in range(count)])
    return F.when(F.size(given) > count, F.raise_error(F.lit(f"at most {count} phases")).cast("array<double>")).otherwise(out)


def _pick(values: list, by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


# Test values, used by the queries and their SQL in this order.
_IPS = ["10.0.1.1", "0.0.0.0", "239.1.2.3", "255.255.255.255", "999.1.1.1", "10.20.30.40", "1.2.3"]
_MACS = ["02:AA:BB:CC:DD:EE", "00:00:00:00:00:00", "01:00:5e:00:00:01", "bad", "02:00:00:00:00:01"]
_MODES = ["time_only", "Spec-Only", "time spec", "dual", "wide"]


def _configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration a packet, most with something wrong."""
    e = F.col("e")
    k = lambda m: e % m == 0
    endpoint = lambda x: F.struct(
        F.when(k(29) & (x == 5), 4).otherwise(x).alias("endpoint_id"), F.when(k(31) & (x == 3), "SPEC").when(x < 8, "TIME").otherwise("SPEC").alias("stream"), F.when(x < 8, e % 3 != 1).otherwise(e % 3 != 0).alias("enabled"),
        F.when(k(37) & (x == 9), _pick(_IPS, F.expr("e div 37"))).otherwise("10.0.1.16").alias("ip"), F.when(k(41) & (x == 2), _pick(_MACS, F.expr("e div 41"))).otherwise("08:c0:eb:d5:95:b2").alias("mac"),
        F.when(k(43) & (x == 1), F.when(k(2), 0).otherwise(65536)).otherwise(4000 + x).alias("source_port"), F.when(k(47) & (x == 7), 0).otherwise(4300 + x).alias("destination_port"),
    )
    channel = lambda x: F.struct(
        F.when(k(53) & (x == 6), 5).otherwise(x).alias("channel"), F.lit(True).alias("enabled"), F.when(k(59) & (x == 0), float("nan")).when(k(61) & (x == 1), 49.9).otherwise(100.0 + x * 10).alias("rf_frequency_mhz"),
        F.when(k(67) & (x == 2), -1.0).otherwise(25.0).alias("amplitude_percent"), F.when(k(71) & (x == 3), 181.0).otherwise(10.0 * x).alias("phase_deg"),
    )
    every = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    return packets(spark, sf_dir).select(
        "e", F.when(k(13), 20).when(k(3), 200).otherwise(100).alias("bandwidth_mhz"), _pick(_MODES, F.expr("e div 3")).alias("mode"), (40.0 + e % 330).alias("center_mhz"), F.when(k(73), -1).otherwise(e % 70000).cast("int").alias("board_id"),
        F.when(k(5), _pick(_IPS, F.expr("e div 5"))).otherwise(" 10.0.1.1 ").alias("source_ip"), F.when(k(7), _pick(_MACS, F.expr("e div 7"))).otherwise("02:00:00:00:00:01").alias("source_mac"),
        every(F.when(k(23), 23).otherwise(24), endpoint).alias("endpoints"), every(F.when(k(79), 7).otherwise(8), channel).alias("channels"),
    )


def q_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configuration_errors(_configurations(spark, sf_dir)).select("e", F.array_join("errors", ",").alias("errors"))


def q_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _configurations(spark, sf_dir).withColumn("mode", mode_name(F.col("mode")))
    wide = c.withColumn("center_mhz", F.col("center_mhz") + 20)
    start = F.col("e")
    asked = c.select("e", (start % 11).alias("generation"), (start % 13).alias("target_pps"), (start % 17).alias("epoch_tai"), F.when(start % 3 != 0, start % 23).alias("first_sample0"), (start % 19).alias("mts_result_id"), F.when(start % 29 != 0, 1).alias("signal_chain_tag"))
    out = request_error(wide).select("e", F.col("error").alias("configure"))
    return out.join(channels_error(wide).select("e", F.col("error").alias("channels")), "e").join(start_error(asked).select("e", F.col("error").alias("start")), "e")


def q_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    df = packets(spark, sf_dir).select(
        "e", _pick([20, 100, 200, 50], e).alias("bandwidth_mhz"), _pick(_MODES, e).alias("output_mode"), (e * 37 % 20000).cast("int").alias("display_points"), _pick(["dual", "samples", "curve", "other"], e).alias("view_mode"), (e % 4000 / 100).alias("time_window_us"),
        F.pow(F.lit(10.0), (e % 10 - 1).cast("double")).alias("vertical_scale"), (e % 1024).cast("int").alias("channel_mask"), F.when(e % 2 == 0, 0.0).otherwise(61.5).alias("expected_mhz"), F.when(e % 3 == 0, float("nan")).otherwise(62.5).alias("dac_mhz"), F.lit(100.0).alias("center_mhz"),
        F.array(F.when(e % 5 == 0, float("inf")).otherwise(70.0), F.when(e % 7 == 0, -1.0).otherwise(80.0)).alias("target_mhz"),
    )
    out = sanitised(df)
    return out.select("e", "bandwidth_mhz", "output_mode", "display_points", "view_mode", F.round("time_window_us", 6).alias("time_window_us"), F.round("vertical_scale", 6).alias("vertical_scale"), "channel_mask", F.col("target_mhz")[0].alias("target_0"), F.col("target_mhz")[1].alias("target_1"))


def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status words unpacked to one column a flag."""
    return unpacked_status(packets(spark, sf_dir).select("e", (F.col("e") * 7919 % 64).alias("word")), "word").drop("word")


def q_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored link states beside live ones; which was taken, and all columns as one text."""
    e = F.col("e")
    cols = {c: ((e * (k + 3)) % 5).cast("int") for k, c in enumerate(LIVE_COLUMNS)}
    live = {"live_" + c: F.when(e % (11 + k) == 0, F.when(e % 2 == 0, 1 - good).otherwise(None)).otherwise(good) for k, (c, good) in enumerate([*((c, 1) for c in LIVE_TRUE), *((c, 0) for c in LIVE_FALSE), ("tx_underflow", 7), ("tx_overflow", 8)])}
    out = with_live_link(packets(spark, sf_dir).select("e", *(v.alias(c) for c, v in (cols | live).items())))
    return out.select("e", "source", F.concat_ws(",", *(F.col(c).cast("string") for c in LIVE_COLUMNS)).alias("link"))


def q_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases by map and by list, both in part; as texts of tenths."""
    e = F.col("e")
    given = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, range(8))), F.array(*[(e % 50 + k).cast("double") for k in range(8)])), lambda k, _: (e + k) % 3 == 0)
    some = F.slice(F.array(*[(e % 40 + k).cast("double") for k in range(8)]), 1, (e % 9).cast("int"))
    offset, step = (e % 7).cast("double"), F.lit(22.5)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.round(x * 10).cast("long").cast("string")), ",")
    return packets(spark, sf_dir).select("e", text(phases_by_channel(given, offset, step)).alias("by_map"), text(phases_of_list(some, offset, step)).alias("by_list"))


QUERIES = {"configuration_rules": q_configurations, "request_checks": q_requests, "display_sanitise": q_sanitised, "status_unpack": q_status, "live_link": q_live, "channel_phases": q_phases}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_IP = "regexp_matches({0}, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"
_MAC = "regexp_matches(lower({0}), '^([0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}}$')"
_GOOD_IP = f"({_IP} AND {{0}} NOT IN ('0.0.0.0', '255.255.255.255') AND NOT regexp_matches({{0}}, '^(22[4-9]|23[0-9])\\.'))"
_GOOD_MAC = f"({_MAC} AND {{0}} <> '00:00:00:00:00:00' AND NOT regexp_matches(lower({{0}}), '^.[13579bdf]'))"
_CONFIGS = f"""c AS (SELECT e, CASE WHEN e % 13 = 0 THEN 20 WHEN e % 3 = 0 THEN 200 ELSE 100 END AS mhz, ['time_only', 'spec_only', 'time_spec', 'time_spec', NULL][e // 3 % 5 + 1] AS mode, 40.0::DOUBLE + e % 330 AS center, CASE WHEN e % 73 = 0 THEN -1 ELSE e % 70000 END AS board,
        CASE WHEN e % 5 = 0 THEN {_list(_IPS)}[e // 5 % 7 + 1] ELSE '10.0.1.1' END AS ip, CASE WHEN e % 7 = 0 THEN {_list(_MACS)}[e // 7 % 5 + 1] ELSE '02:00:00:00:00:01' END AS mac,
        {_list(_IPS)}[e // 37 % 7 + 1] AS ip9, {_list(_MACS)}[e // 41 % 5 + 1] AS mac2, CASE WHEN e % 23 = 0 THEN 23 ELSE 24 END AS n, CASE WHEN e % 79 = 0 THEN 7 ELSE 8 END AS m FROM packets),
    f AS (SELECT *, mode IS NOT NULL AND mhz IN (100, 200) AND NOT (mhz = 200 AND mode = 'time_spec') AS profile, CASE WHEN mhz = 100 THEN 61.44 ELSE 122.88 END::DOUBLE AS half FROM c)"""
_RULES = [
    ("MODE", "mode IS NULL"), ("PROFILE", "NOT profile"), ("CENTER", "center NOT BETWEEN 50 AND 350"), ("BOARD_ID", "board NOT BETWEEN 0 AND 65535"), ("SOURCE_IP", "NOT " + _GOOD_IP.format("ip")), ("SOURCE_MAC", "NOT " + _GOOD_MAC.format("mac")),
    ("TIME_ENDPOINTS", "e % 31 = 0"), ("SPEC_ENDPOINTS", "(e % 31 = 0)::INTEGER <> (e % 23 = 0)::INTEGER"), ("DESTINATION_IP", "e % 37 = 0 AND NOT " + _IP.format("ip9")), ("DESTINATION_MAC", "e % 41 = 0 AND NOT " + _MAC.format("mac2")), ("DESTINATION_PORT", "e % 47 = 0"), ("SOURCE_PORT", "e % 43 = 0"),
    ("CHANNELS", "m <> 8"), ("FREQUENCY", "e % 59 = 0 OR e % 61 = 0"), ("AMPLITUDE", "e % 67 = 0"), ("PHASE", "e % 71 = 0"),
    ("NYQUIST_BAND", "e % 59 = 0 OR 100 + (m - 1) * 10 > center + half OR (CASE WHEN e % 61 = 0 THEN 49.9 ELSE 100 END) < center - half OR 100 < center - half"),
]
_LIVE = [*((c, 1) for c in LIVE_TRUE), *((c, 0) for c in LIVE_FALSE), ("tx_underflow", 7), ("tx_overflow", 8)]
_LIVE_VALUE = [f"CASE WHEN e % {11 + k} = 0 THEN CASE WHEN e % 2 = 0 THEN {1 - good} END ELSE {good} END" for k, (_, good) in enumerate(_LIVE)]
_READY = " AND ".join(f"coalesce({v}, {1 if c == 'udp_dry_run_active' else 0}) {'<>' if good else '='} 0" for (c, good), v in zip(_LIVE[:9], _LIVE_VALUE, strict=False))
_LINK = "concat_ws(',', " + ", ".join(f"CASE WHEN r THEN coalesce({v}, e * {k + 3} % 5) ELSE e * {k + 3} % 5 END" for k, v in enumerate(_LIVE_VALUE)) + ")"

SQL = {
    "configuration_rules": sql("packets", "").strip() + ", " + _CONFIGS + " SELECT e, concat_ws(',', " + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in _RULES) + ") AS errors FROM f",
    "request_checks": sql("packets", "").strip() + ", " + _CONFIGS + f""" SELECT e, CASE WHEN NOT profile THEN 'PROFILE' WHEN center + 20 NOT BETWEEN 50 AND 350 THEN 'CENTER' WHEN NOT {_GOOD_IP.format('ip')} THEN 'SOURCE_IP' WHEN NOT {_GOOD_MAC.format('mac')} THEN 'SOURCE_MAC' WHEN n <> 24 THEN 'ENDPOINT_COUNT'
            WHEN e % 43 = 0 THEN 'ENDPOINT_PORT' WHEN e % 41 = 0 AND NOT {_GOOD_MAC.format('mac2')} THEN 'ENDPOINT_MAC' WHEN e % 31 = 0 THEN 'ENDPOINT_STREAM' WHEN e % 29 = 0 THEN 'ENDPOINT_ID' WHEN e % 47 = 0 THEN 'ENDPOINT_PORT' WHEN e % 37 = 0 AND NOT {_GOOD_IP.format('ip9')} THEN 'ENDPOINT_IP'
            WHEN NOT CASE mode WHEN 'time_only' THEN e % 3 = 0 WHEN 'spec_only' THEN e % 3 = 1 ELSE e % 3 = 2 END THEN 'ENABLE_MASK' END AS configure,
        CASE WHEN center + 20 NOT BETWEEN 50 AND 350 THEN 'CENTER' WHEN m <> 8 THEN 'CHANNEL_COUNT' WHEN e % 59 = 0 OR e % 61 = 0 THEN 'FREQUENCY' WHEN e % 67 = 0 THEN 'AMPLITUDE' WHEN e % 71 = 0 THEN 'PHASE' WHEN e % 53 = 0 THEN 'CHANNEL_ID' END AS channels,
        CASE WHEN e % 11 = 0 THEN 'GENERATION' WHEN e % 13 = 0 THEN 'TARGET_PPS' WHEN e % 17 = 0 THEN 'EPOCH_TAI' WHEN e % 3 <> 0 AND (e % 23 = 0 OR e % 23 % 4 <> 0) THEN 'FIRST_SAMPLE0' WHEN e % 19 = 0 THEN 'MTS_RESULT' WHEN e % 29 = 0 THEN 'SIGNAL_CHAIN' END AS start FROM f""",
    "display_sanitise": sql("packets", """SELECT e, [20, 100, 200, 100][e % 4 + 1]::INTEGER AS bandwidth_mhz, CASE WHEN e % 5 = 0 THEN 'time_only' ELSE 'time_spec' END AS output_mode, greatest(64, least(16384, e * 37 % 20000))::INTEGER AS display_points, ['dual', 'samples', 'curve', 'dual'][e % 4 + 1] AS view_mode,
        round(greatest(0.02, least(25.0, e % 4000 / 100)), 6) AS time_window_us, round(greatest(1.0::DOUBLE, least(1e6, 10.0::DOUBLE ** (e % 10 - 1))), 6) AS vertical_scale, (CASE WHEN e % 256 = 0 THEN 1 ELSE e % 256 END)::INTEGER AS channel_mask, CASE WHEN e % 5 = 0 THEN t ELSE 70.0::DOUBLE END AS target_0, CASE WHEN e % 7 = 0 THEN t ELSE 80.0::DOUBLE END AS target_1
        FROM (SELECT e, CASE WHEN e % 2 = 1 THEN 61.5 WHEN e % 3 <> 0 THEN 62.5 ELSE 100.0 END::DOUBLE AS t FROM packets)"""),
    "status_unpack": sql("packets", "SELECT e, w & 1 = 1 AS time_valid, w & 2 = 2 AS pps_locked, w & 4 = 4 AS ref_locked, w & 8 = 8 AS rfdc_ready, w & 16 = 16 AS streaming, w & 32 = 32 AS fifo_overflow FROM (SELECT e, e * 7919 % 64 AS w FROM packets)"),
    "live_link": sql("packets", f"SELECT e, CASE WHEN r THEN 'live' ELSE 'snapshot' END AS source, {_LINK} AS link FROM (SELECT e, {_READY} AS r FROM packets)"),
    "channel_phases": sql("packets", """SELECT e, array_to_string(list_transform(range(8), lambda k: (round(10 * CASE WHEN (e + k) % 3 = 0 THEN e % 50 + k ELSE e % 7 + 22.5 * k END))::BIGINT), ',') AS by_map,
        array_to_string(list_transform(range(8), lambda k: (round(10 * CASE WHEN k < e % 9 THEN e % 40 + k ELSE e % 7 + 22.5 * k END))::BIGINT), ',') AS by_list FROM packets"""),
}
