"""Continuity and statistics of flows: gaps, losses, rates, partial and final merges, counters, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.functions.bits import delta_mod
from fluxframe.functions.signal import capture_count, expected_sample_delta, infer_bandwidth, payload_rate
from fluxframe.operators.ordered import SPAN, previous, running
from fluxframe.operators.validate import classified, classified_sql
from fluxframe.plans.views import counters, packets, sql

U32 = 1 << 32


def continuity(df: DataFrame, stride: int, mhz: Column, order: str = "seq_no", span: int = SPAN) -> DataFrame:
    """Per packet the gaps against the flow's packet before: numbers advance by stride (the number of flows), sample0 by
    stride packets' samples. The first packet of a flow has no gap. drops counts the packets that a gap lost. A flow is as
    many tasks as it has blocks of span numbers."""
    df = previous(df, ["flow_id"], order, ["seq_no", "frame_id", "sample0"], span)
    step = delta_mod(F.col("seq_no"), F.col("_seq_no"))
    frame = delta_mod(F.col("frame_id"), F.col("_frame_id"), 64)
    moved = delta_mod(F.col("sample0"), F.col("_sample0"), 64)
    has = F.col("_seq_no").isNotNull()
    lost = F.when(step > stride, F.greatest(F.floor(step / stride) - 1, F.lit(0))).otherwise(F.lit(1))
    flag = lambda c: F.when(has & c, 1).otherwise(0)
    return df.withColumns({
        "seq_gap": flag(step != stride),
        "frame_gap": flag(frame != stride),
        "sample0_gap": flag(moved != expected_sample_delta(F.col("time_count"), mhz) * stride),
        "app_drops": F.when(has & (step != stride), lost).otherwise(F.lit(0)).cast("long"),
        "detected_mhz": F.when(has & (F.pmod(moved, F.lit(stride)) == 0), infer_bandwidth((moved / stride).cast("long"), F.col("time_count"))),
    }).drop("_seq_no", "_frame_id", "_sample0")


def receiver_statistics(df: DataFrame, time_flows: int, spec_flows: int, mhz: Column, span: int = SPAN) -> DataFrame:
    """All that the receiver tells of each flow: packets, bytes, gaps, and last values of its TIME and its SPEC packets, its
    ports, rates over its span, and the bandwidth its TIME packets suggest last. Each kind's packets advance by the number of
    flows that carry it; gaps are counted against the kind's own packet before. df has ts and the packets' header columns."""
    time = F.col("stream_type") == 1
    stride = F.when(time, F.lit(time_flows)).otherwise(F.lit(max(1, spec_flows)))
    x = previous(df.filter(F.col("stream_type").isin(0, 1)), ["flow_id", "stream_type"], "seq_no", ["seq_no", "frame_id", "sample0"], span)
    has = F.col("_seq_no").isNotNull()
    moved = delta_mod(F.col("sample0"), F.col("_sample0"), 64)
    x = x.withColumns({
        "_seq": has & (delta_mod(F.col("seq_no"), F.col("_seq_no")) != stride), "_frame": has & (delta_mod(F.col("frame_id"), F.col("_frame_id"), 64) != stride),
        "_sample": has & (moved != expected_sample_delta(F.col("time_count"), mhz) * time_flows), "_mhz": F.when(has & time & (F.pmod(moved, F.lit(time_flows)) == 0), infer_bandwidth((moved / time_flows).cast("long"), F.col("time_count"))),
    })
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    last = lambda c, of: F.max_by(F.when(of, F.col(c)), F.when(of, F.col("seq_no")))
    size = F.col("udp_payload_len").cast("long")
    total = lambda of: F.coalesce(F.sum(F.when(of, size)), F.lit(0)).cast("long")
    seconds = F.greatest(F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp"))), F.lit(1))
    out = x.groupBy("flow_id").agg(
        F.max_by("dst_port", "seq_no").alias("dst_port"), F.max_by("src_port", "seq_no").alias("src_port"), count(time).alias("time_packets"), total(time).alias("time_bytes"), count(~time).alias("spec_packets"), total(~time).alias("spec_bytes"),
        (F.count("*") / seconds).alias("packets_per_sec"), (F.sum(size) * 8 / seconds / 1e9).alias("gbps"), count(time & F.col("_seq")).alias("seq_gaps"), count(time & F.col("_frame")).alias("frame_gaps"), count(time & F.col("_sample")).alias("sample0_gaps"),
        count(~time & F.col("_seq")).alias("spec_seq_gaps"), count(~time & F.col("_frame")).alias("spec_frame_gaps"), F.max_by(F.col("_mhz"), F.when(F.col("_mhz").isNotNull(), F.col("seq_no"))).alias("detected_mhz"),
        *[last(c, time).alias(f"last_{c}") for c in ("seq_no", "frame_id", "sample0")], *[last(c, ~time).alias(f"last_spec_{c}") for c in ("seq_no", "frame_id", "sample0", "chan0", "chan_count")],
    )
    return out


def saturating_totals(df: DataFrame, keys: list[str], columns: list[str], bits: int = 64) -> DataFrame:
    """Sums that stop at the largest number of so many bits, as decimals."""
    most = F.lit((1 << bits) - 1).cast("decimal(38,0)") if bits < 63 else F.expr(f"cast('{(1 << bits) - 1}' as decimal(38,0))")
    return df.groupBy(*keys).agg(*[F.least(F.sum(F.col(c).cast("decimal(28,0)")), most).alias(c) for c in columns])


def flow_statistics(df: DataFrame) -> DataFrame:
    """Counters and last values of each flow of a DataFrame from continuity()."""
    last = lambda c: F.max_by(c, "seq_no").alias(f"last_{c}")
    return df.groupBy("flow_id").agg(
        F.count("*").alias("packets"), F.sum("udp_payload_len").cast("long").alias("bytes"),
        F.sum("seq_gap").alias("seq_gaps"), F.sum("frame_gap").alias("frame_gaps"), F.sum("sample0_gap").alias("sample0_gaps"), F.sum("app_drops").alias("app_drops"),
        consensus(F.col("detected_mhz")).alias("detected_mhz"), last("seq_no"), last("frame_id"), last("sample0"),
    )


def consensus(c: Column) -> Column:
    """The one value that all non-null ones agree on, else null."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def loss_percent(lost: Column, got: Column) -> Column:
    return F.when(lost + got > 0, F.round(lost / (lost + got) * 100, 6)).otherwise(F.lit(0.0))


def gap_report(df: DataFrame, stride: int = 8, mhz: int = 200) -> DataFrame:
    """Valid packets' continuity by flow, with the share lost."""
    good = classified(df).filter(F.col("route").isin("TIME", "SPEC"))
    stats = flow_statistics(continuity(good, stride, F.lit(mhz)))
    return stats.withColumn("loss_percent", loss_percent(F.col("app_drops"), F.col("packets")))


def partial_statistics(df: DataFrame) -> DataFrame:
    """What each worker reports: sums, maxima and last values of the flows it reads."""
    return df.groupBy("worker_id", "flow_id").agg(F.count("*").alias("packets"), F.sum("udp_payload_len").cast("long").alias("bytes"), F.max("seq_no").alias("last_seq"), F.max_by("detected_mhz", "seq_no").alias("detected_mhz"), (F.count("*") / F.lit(10.0)).alias("pps"))


def merged_statistics(parts: DataFrame) -> DataFrame:
    """Reports of all workers by flow: sums add, and detection and last values come from an active worker (over 0.5
    packets a second) before an idle one, then from the largest worker id."""
    key = F.struct(F.col("pps") > 0.5, F.col("worker_id"))
    return parts.groupBy("flow_id").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.max_by("last_seq", key).alias("last_seq"), F.max_by("detected_mhz", key).alias("detected_mhz"), F.count("*").alias("workers"))


def counter_deltas(df: DataFrame, bits: int = 32) -> DataFrame:
    w = Window.partitionBy("board_id").orderBy("day")
    return df.select("board_id", "day", "value", delta_mod(F.col("value"), F.lag("value").over(w), bits).alias("delta"))


def coverage(df: DataFrame) -> DataFrame:
    """Blocks seen of each frame group, up to 128, as two masks of 64 bits and a count; complete once all blocks are there."""
    half = lambda lo: F.coalesce(F.bit_or(F.when(F.col("block_index").between(lo, lo + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block_index") - lo))), F.lit(0).cast("long"))
    out = df.groupBy("frame_group").agg(half(0).alias("mask_lo"), half(64).alias("mask_hi"), F.max("block_count").alias("blocks"))
    seen = (F.bit_count("mask_lo") + F.bit_count("mask_hi")).cast("int")
    return out.select("frame_group", "mask_lo", "mask_hi", seen.alias("seen"), (seen >= F.col("blocks")).alias("complete"))


def agreed(x: Column, tolerance: float = 1e-6) -> Column:
    """The mean of values that agree within the tolerance, else null."""
    return F.when(F.max(x) - F.min(x) < tolerance, F.avg(x))


def first_enabled(value: Column, enabled: Column, order: Column) -> Column:
    """The value of the first enabled row, else of the first."""
    return F.coalesce(F.min_by(F.when(enabled, value), F.when(enabled, order)), F.min_by(value, order))


def risen(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How much a counter has risen since the row before, 0 where it fell."""
    return df.withColumn("delta", F.greatest(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)), F.lit(0)))


def lanes_mask(lane: Column, enabled: Column) -> Column:
    """The bits of enabled lanes."""
    return F.bit_or(F.when(enabled, F.call_function("shiftleft", F.lit(1), lane)))


def latest(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Each key's values in its last row."""
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(f"last_{c}") for c in columns])


def throttled(df: DataFrame, key: str, order: str, first: int = 16) -> DataFrame:
    """Rows that are logged, with their number k: the first of a key below `first`, then every power of two."""
    numbered = running(df, [key], order, F.lit(1), "k")
    return numbered.filter((F.col("k") < first) | (F.bit_count("k") == 1))


def rates(df: DataFrame, seconds: int) -> DataFrame:
    """Packets and bits a second in tumbling windows."""
    w = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")
    out = df.groupBy(w.alias("w")).agg(F.count("*").alias("packets"), F.sum("udp_payload_len").cast("long").alias("bytes"))
    return out.select(F.unix_timestamp(F.col("w.start")).alias("start_s"), "packets", F.round(F.col("packets") / seconds, 6).alias("pps"), F.round(F.col("bytes") * 8 / seconds / 1e9, 9).alias("gbps"))


def expected_rates(df: DataFrame) -> DataFrame:
    """Nominal packets a second and payload of profiles (mhz, mode): the samples a second of eight inputs over the
    samples of a packet, for each of its streams."""
    streams = F.when(F.col("mode") == "time_spec", 2).otherwise(1)
    pps = F.when(F.col("mhz") == 200, 960_000).when(F.col("mhz") == 100, 480_000).cast("long")
    payload = pps * streams * 8320 * 8 / 1e6
    flows = F.when(F.col("mode") == "time_only", 8).when(F.col("mode") == "spec_only", 16).otherwise(24)
    return df.select("mhz", "mode", flows.alias("flows"), pps.alias("pps"), F.round(payload, 6).alias("payload_mbps"), ((F.col("mhz") != 200) | (F.col("mode") != "time_spec")).alias("allowed"))


def q_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_report(packets(spark, sf_dir))


def q_receiver_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = receiver_statistics(packets(spark, sf_dir), 8, 8, F.lit(100))
    return out.withColumns({"packets_per_sec": F.round("packets_per_sec", 6), "gbps": F.round("gbps", 12)})


def q_saturating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large counters by board, in 32 and in 64 bits."""
    df = packets(spark, sf_dir).withColumns({"small": F.col("udp_payload_len") * 997, "large": F.lit(1 << 62) - F.col("e")})
    a, b = saturating_totals(df, ["board_id"], ["small"], 32), saturating_totals(df, ["board_id"], ["large"], 64)
    return a.join(b, "board_id").select("board_id", F.col("small").cast("long").alias("small"), F.col("large").cast("string").alias("large"))


def q_blocks_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of 128 blocks, of which some come twice in place of the one that follows."""
    place = F.expr("cast(e % 128 - case when e % 389 = 5 and e % 128 > 0 then 1 else 0 end as int)")
    return coverage(packets(spark, sf_dir).select(F.expr("e div 128").alias("frame_group"), place.alias("block_index"), F.lit(128).alias("block_count")))


def q_flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_statistics(continuity(packets(spark, sf_dir), 8, F.lit(100)))


def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of the bandwidths that packets of a board suggest."""
    df = packets(spark, sf_dir).withColumn("mhz", F.when(F.col("board_id") == 0, None).when(F.col("board_id") == 1, 100).when((F.col("board_id") == 2) & (F.col("e") % 2 == 0), 200).when(F.col("board_id") == 3, F.when(F.col("e") % 2 == 0, 100).otherwise(200)))
    return df.groupBy("board_id").agg(consensus(F.col("mhz")).alias("mhz"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).withColumn("worker_id", F.pmod(F.col("dst_port") - 4300, F.lit(6)).cast("int"))
    return partial_statistics(df.withColumn("detected_mhz", F.when(F.col("e") % 3 == 0, None).otherwise(F.when(F.col("worker_id") % 2 == 0, 100).otherwise(200))))


def q_worker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_statistics(_reports(spark, sf_dir))


def q_worker_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).withColumn("pps", F.round("pps", 6))


def q_counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_deltas(counters(spark, sf_dir))


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(packets(spark, sf_dir))


def q_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(packets(spark, sf_dir), 3600)


def q_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all packets, and the share lost."""
    df = continuity(packets(spark, sf_dir), 8, F.lit(200))
    out = df.agg(F.count("*").alias("packets"), F.sum("udp_payload_len").cast("long").alias("bytes"), F.sum("app_drops").alias("drops"), F.count(F.when(F.col("stream_type") > 1, 1)).alias("filtered"))
    return out.withColumn("loss_percent", loss_percent(F.col("drops"), F.col("packets")))


def q_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = spark.createDataFrame([(b, m) for b in (100, 200) for m in ("time_only", "spec_only", "time_spec")], "mhz int, mode string")
    return expected_rates(cfg)


def q_payload_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of profiles, and samples to capture for windows."""
    e = F.col("e")
    mhz = F.get(F.array(*map(F.lit, [20, 100, 200])), (e % 3).cast("int"))
    mode = F.get(F.array(*map(F.lit, ["time_only", "spec_only", "time_spec", "monitor", "off"])), (e % 5).cast("int"))
    df = packets(spark, sf_dir).select("e", payload_rate(mhz, mode).alias("r"), capture_count(F.lit(245.76e6), (e % 40 + 1) / 10.0, (e % 4).cast("double"), 64, 4096).alias("count"))
    return df.select("e", *[F.round(f"r.{c}", 6).alias(c) for c in ("payload_mbps", "packets_per_sec", "wire_mbps")], F.col("r.allowed").alias("allowed"), "count")


def q_infer_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("e", (F.col("e") % 12 * 256).alias("delta"), F.lit(64).alias("time_count"))
    return df.select("e", "delta", infer_bandwidth(F.col("delta"), F.col("time_count")).alias("mhz"))


def q_consensus_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of positive values that agree to a millionth, else null."""
    df = packets(spark, sf_dir).select("board_id", F.when(F.col("board_id") % 2 == 0, F.lit(100.5)).otherwise(F.col("value")).alias("x")).filter("x > 0")
    return df.groupBy("board_id").agg(F.round(agreed(F.col("x")), 6).alias("x"))


def q_source_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The port of the first enabled endpoint, else of the first."""
    df = packets(spark, sf_dir).withColumn("enabled", (F.col("e") % 7 == 3) & (F.col("board_id") != 2))
    return df.groupBy("board_id").agg(first_enabled(F.col("src_port"), F.col("enabled"), F.col("e")).alias("port"))


def q_nic_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturating differences of a counter that may fall."""
    df = counters(spark, sf_dir).withColumn("now", F.col("value") % 1_000_003)
    return risen(df, "board_id", "day", "now").select("board_id", "day", "delta")


def q_enabled_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("board_id").agg(lanes_mask(F.col("flow_id"), F.col("e") % 5 == 0).alias("mask"))


def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(packets(spark, sf_dir), "board_id", ["seq_no", "frame_id", "sample0", "flow_id"], "seq_no")


def q_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a board's errors are logged: the first 15, then every power of two."""
    bad = classified(packets(spark, sf_dir)).filter(F.col("error").isNotNull())
    return throttled(bad, "board_id", "e").select("board_id", "e", "error", "k")


QUERIES = {
    "gap_report": q_gap_report, "flow_stats": q_flow_stats, "receiver_stats": q_receiver_stats, "saturating_totals": q_saturating, "coverage_128": q_blocks_128, "bandwidth_consensus": q_consensus, "worker_partials": q_worker_partials, "worker_merge": q_worker_merge,
    "counter_delta_mod": q_counter_delta, "coverage_complete": q_coverage, "rate_windows": q_rates, "loss_percent": q_loss, "profile_rates": q_profiles,
    "payload_rates": q_payload_rates, "infer_bandwidth": q_infer_bandwidth, "consensus_float": q_consensus_float, "source_port": q_source_port, "nic_rates": q_nic_rates,
    "enabled_mask": q_enabled_mask, "latest_values": q_latest, "error_log_throttle": q_error_log,
}


def _continuity_sql(source: str, decimation: int) -> str:
    return f"""d AS (SELECT *, seq_no - lag(seq_no) OVER w AS step, frame_id - lag(frame_id) OVER w AS frame, sample0 - lag(sample0) OVER w AS moved FROM {source} WINDOW w AS (PARTITION BY flow_id ORDER BY seq_no)),
    c AS (SELECT *, (step IS NOT NULL AND step <> 8)::INTEGER AS seq_gap, (frame IS NOT NULL AND frame <> 8)::INTEGER AS frame_gap, (moved IS NOT NULL AND moved <> time_count * 4 * {decimation} * 8)::INTEGER AS sample0_gap,
        CASE WHEN step IS NULL OR step = 8 THEN 0 WHEN step > 8 THEN greatest(step // 8 - 1, 0) ELSE 1 END AS app_drops,
        CASE WHEN moved IS NULL OR moved % 8 <> 0 OR time_count <= 0 THEN NULL WHEN moved // 8 = time_count * 4 THEN 200 WHEN moved // 8 = time_count * 8 THEN 100 WHEN moved // 8 = time_count * 32 THEN 20 END AS detected FROM d)"""


_STATS = """flow_id, count(*) AS packets, sum(udp_payload_len)::BIGINT AS bytes, sum(seq_gap)::BIGINT AS seq_gaps, sum(frame_gap)::BIGINT AS frame_gaps, sum(sample0_gap)::BIGINT AS sample0_gaps, sum(app_drops)::BIGINT AS app_drops,
    CASE WHEN min(detected) = max(detected) THEN min(detected) END::INTEGER AS detected_mhz, max(seq_no) AS last_seq_no, arg_max(frame_id, seq_no) AS last_frame_id, arg_max(sample0, seq_no) AS last_sample0"""
_PARTS = """p AS (SELECT (dst_port - 4300) % 6 AS worker_id, flow_id, udp_payload_len, seq_no, CASE WHEN e % 3 <> 0 THEN CASE WHEN (dst_port - 4300) % 2 = 0 THEN 100 ELSE 200 END END AS mhz FROM packets),
    parts AS (SELECT worker_id::INTEGER AS worker_id, flow_id, count(*) AS packets, sum(udp_payload_len)::BIGINT AS bytes, max(seq_no) AS last_seq, (arg_max_null(mhz, seq_no))::INTEGER AS detected_mhz, count(*) / 10.0 AS pps FROM p GROUP BY ALL)"""


def _over(views: str, more: str, query: str) -> str:
    return sql(views, "").strip() + ", " + more + " " + query


SQL = {
    "gap_report": classified_sql("").strip() + ", g AS (SELECT * FROM classified WHERE route IN ('TIME', 'SPEC')), " + _continuity_sql("g", 1) + f", s AS (SELECT {_STATS} FROM c GROUP BY flow_id) SELECT *, CASE WHEN app_drops + packets > 0 THEN round(app_drops / (app_drops + packets) * 100, 6) ELSE 0.0 END AS loss_percent FROM s",
    "flow_stats": _over("packets", _continuity_sql("packets", 2), f"SELECT {_STATS} FROM c GROUP BY flow_id"),
    "bandwidth_consensus": sql("packets", "SELECT board_id, CASE WHEN min(m) = max(m) THEN min(m) END::INTEGER AS mhz FROM (SELECT board_id, CASE WHEN board_id = 1 THEN 100 WHEN board_id = 2 AND e % 2 = 0 THEN 200 WHEN board_id = 3 THEN CASE WHEN e % 2 = 0 THEN 100 ELSE 200 END END AS m FROM packets) GROUP BY board_id"),
    "worker_partials": _over("packets", _PARTS, "SELECT * REPLACE (round(pps, 6)::DOUBLE AS pps) FROM parts"),
    "worker_merge": _over("packets", _PARTS, "SELECT flow_id, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes, arg_max(last_seq, worker_id + CASE WHEN pps > 0.5 THEN 100 ELSE 0 END) AS last_seq, arg_max_null(detected_mhz, worker_id + CASE WHEN pps > 0.5 THEN 100 ELSE 0 END) AS detected_mhz, count(*) AS workers FROM parts GROUP BY flow_id"),
    "counter_delta_mod": sql("counters", "SELECT board_id, day, value, (value - lag(value) OVER (PARTITION BY board_id ORDER BY day) + 4294967296) % 4294967296 AS delta FROM counters"),
    "receiver_stats": _over("packets", """x AS (SELECT *, stream_type = 1 AS t, lag(seq_no) OVER w AS s, lag(frame_id) OVER w AS f, lag(sample0) OVER w AS m FROM packets WHERE stream_type IN (0, 1) WINDOW w AS (PARTITION BY flow_id, stream_type ORDER BY seq_no)),
        y AS (SELECT *, (sample0 - m) // 8 AS d, s IS NOT NULL AND seq_no - s <> 8 AS sg, s IS NOT NULL AND frame_id - f <> 8 AS fg, s IS NOT NULL AND sample0 - m <> time_count * 64 AS mg FROM x),
        z AS (SELECT *, CASE WHEN t AND (sample0 - m) % 8 = 0 AND time_count > 0 THEN CASE WHEN d = time_count * 4 THEN 200 WHEN d = time_count * 8 THEN 100 WHEN d = time_count * 32 THEN 20 END END AS mhz FROM y)""",
        """SELECT flow_id, arg_max(dst_port, seq_no) AS dst_port, arg_max(src_port, seq_no) AS src_port, count(*) FILTER (t) AS time_packets, coalesce(sum(udp_payload_len) FILTER (t), 0)::BIGINT AS time_bytes, count(*) FILTER (NOT t) AS spec_packets, coalesce(sum(udp_payload_len) FILTER (NOT t), 0)::BIGINT AS spec_bytes,
        round(count(*) / greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 1), 6) AS packets_per_sec, round(sum(udp_payload_len)::BIGINT * 8 / greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 1) / 1e9, 12) AS gbps, count(*) FILTER (t AND sg) AS seq_gaps, count(*) FILTER (t AND fg) AS frame_gaps, count(*) FILTER (t AND mg) AS sample0_gaps,
        count(*) FILTER (NOT t AND sg) AS spec_seq_gaps, count(*) FILTER (NOT t AND fg) AS spec_frame_gaps, arg_max(mhz, seq_no)::INTEGER AS detected_mhz, max(seq_no) FILTER (t) AS last_seq_no, arg_max(frame_id, seq_no) FILTER (t) AS last_frame_id, arg_max(sample0, seq_no) FILTER (t) AS last_sample0,
        max(seq_no) FILTER (NOT t) AS last_spec_seq_no, arg_max(frame_id, seq_no) FILTER (NOT t) AS last_spec_frame_id, arg_max(sample0, seq_no) FILTER (NOT t) AS last_spec_sample0, arg_max(chan0, seq_no) FILTER (NOT t) AS last_spec_chan0, arg_max(chan_count, seq_no) FILTER (NOT t) AS last_spec_chan_count FROM z GROUP BY flow_id"""),
    "saturating_totals": sql("packets", "SELECT board_id, least(sum(udp_payload_len::BIGINT * 997), 4294967295)::BIGINT AS small, least(sum(4611686018427387904 - e), 18446744073709551615)::VARCHAR AS large FROM packets GROUP BY board_id"),
    "coverage_128": sql("packets", """SELECT g AS frame_group, coalesce(bit_or(1::BIGINT << least(62, b)::INTEGER) FILTER (b < 63), 0) + CASE WHEN bool_or(b = 63) THEN -9223372036854775808 ELSE 0 END::BIGINT AS mask_lo,
        coalesce(bit_or(1::BIGINT << greatest(0, least(62, b - 64))::INTEGER) FILTER (b BETWEEN 64 AND 126), 0) + CASE WHEN bool_or(b = 127) THEN -9223372036854775808 ELSE 0 END::BIGINT AS mask_hi, count(DISTINCT b)::INTEGER AS seen, count(DISTINCT b) = 128 AS complete
        FROM (SELECT e // 128 AS g, e % 128 - CASE WHEN e % 389 = 5 AND e % 128 > 0 THEN 1 ELSE 0 END AS b FROM packets) GROUP BY g"""),
    "coverage_complete": sql("packets", "SELECT frame_group, bit_or(1::BIGINT << block_index) AS mask_lo, 0::BIGINT AS mask_hi, bit_count(bit_or(1::BIGINT << block_index))::INTEGER AS seen, bit_count(bit_or(1::BIGINT << block_index)) >= max(block_count) AS complete FROM packets GROUP BY frame_group"),
    "rate_windows": sql("packets", "SELECT start_s, count(*) AS packets, round(count(*) / 3600, 6) AS pps, round(sum(udp_payload_len)::BIGINT * 8 / 3600 / 1e9, 9) AS gbps FROM (SELECT *, floor(epoch(ts))::BIGINT // 3600 * 3600 AS start_s FROM packets) GROUP BY start_s"),
    "loss_percent": _over("packets", _continuity_sql("packets", 1), "SELECT *, round(drops / (drops + packets) * 100, 6) AS loss_percent FROM (SELECT count(*) AS packets, sum(udp_payload_len)::BIGINT AS bytes, sum(app_drops)::BIGINT AS drops, count(*) FILTER (stream_type > 1) AS filtered FROM c)"),
    "profile_rates": """SELECT mhz, mode, CASE mode WHEN 'time_only' THEN 8 WHEN 'spec_only' THEN 16 ELSE 24 END AS flows, (mhz * 4800)::BIGINT AS pps, round((mhz * 4800)::BIGINT * CASE mode WHEN 'time_spec' THEN 2 ELSE 1 END * 8320 * 8 / 1e6, 6) AS payload_mbps, mhz <> 200 OR mode <> 'time_spec' AS allowed
        FROM (SELECT unnest([100, 200]) AS mhz), (SELECT unnest(['time_only', 'spec_only', 'time_spec']) AS mode)""",
    "payload_rates": sql("packets", """SELECT e, round(b / 1e6, 6) AS payload_mbps, round(b / 8 / 8192, 6) AS packets_per_sec, round(b / 1e6 * 8386 / 8192, 6) AS wire_mbps, NOT (e % 3 = 2 AND e % 5 = 2) AS allowed, least(4096, (2 ** ceil(log2(greatest(64, ceil(245.76e6 * ((e % 40 + 1) / 10.0::DOUBLE) * 1e-6 * greatest(1, e % 4))))))::BIGINT) AS count
        FROM (SELECT e, 245760000.0::DOUBLE / [8, 2, 1][e % 3 + 1] * 256 * [1, 1, 2, 1.015625, 0][e % 5 + 1]::DOUBLE AS b FROM packets)"""),
    "infer_bandwidth": sql("packets", "SELECT e, e % 12 * 256 AS delta, (CASE e % 12 * 256 WHEN 256 THEN 200 WHEN 512 THEN 100 WHEN 2048 THEN 20 END)::INTEGER AS mhz FROM packets"),
    "consensus_float": sql("packets", "SELECT board_id, CASE WHEN max(x) - min(x) < 1e-6 THEN round(avg(x), 6) END AS x FROM (SELECT board_id, CASE WHEN board_id % 2 = 0 THEN 100.5::DOUBLE ELSE value END AS x FROM packets) WHERE x > 0 GROUP BY board_id"),
    "source_port": sql("packets", "SELECT board_id, coalesce(arg_min(src_port, e) FILTER (e % 7 = 3 AND board_id <> 2), arg_min(src_port, e)) AS port FROM packets GROUP BY board_id"),
    "nic_rates": sql("counters", "SELECT board_id, day, greatest(v - lag(v) OVER (PARTITION BY board_id ORDER BY day), 0) AS delta FROM (SELECT *, value % 1000003 AS v FROM counters)"),
    "enabled_mask": sql("packets", "SELECT board_id, bit_or(1 << flow_id) FILTER (e % 5 = 0)::INTEGER AS mask FROM packets GROUP BY board_id"),
    "latest_values": sql("packets", "SELECT board_id, max(seq_no) AS last_seq_no, arg_max(frame_id, seq_no) AS last_frame_id, arg_max(sample0, seq_no) AS last_sample0, arg_max(flow_id, seq_no) AS last_flow_id FROM packets GROUP BY board_id"),
    "error_log_throttle": classified_sql("SELECT board_id, e, error, k FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY e) AS k FROM classified WHERE error IS NOT NULL) WHERE k < 16 OR bit_count(k) = 1"),
}
