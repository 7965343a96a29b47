"""Packet validation: the first check that fails names the error; demultiplexing, layouts, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.plans.views import packets, samples, sql

# The wire format.
MAGIC, VERSIONS, HEADER_BYTES = 0x54353130, (2, 3), 128
SPEC, TIME = 0, 1
NINPUT, INT16, PAYLOAD_BYTES, PRODUCT, NCHAN = 8, 0, 8192, 0xF101, 4096
FFT_ONLY, PFB_ACTIVE = 1 << 8, 1 << 10
# Names of errors, in order of their codes.
ERRORS = (
    "FrameTooShort", "NonIpv4Ethernet", "UnsupportedIpv4Header", "TruncatedIpv4Udp", "NonUdpIpv4", "WrongUdpDstPort", "BadUdpLength",
    "UdpPayloadTooShort", "BadMagic", "UnsupportedVersion", "UnexpectedHeaderBytes", "NotTimeStream", "NotSpecStream",
    "UnsupportedNinput", "UnsupportedPayloadFormat", "UnexpectedPayloadBytes", "UnsupportedProduct", "UnexpectedSpecLayout",
    "TruncatedPayload", "TruncatedTimePayload", "TruncatedSpecPayload",
)


def first_of(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def header_error() -> Column:
    return first_of(
        (F.col("magic") != MAGIC, "BadMagic"),
        (~F.col("version").isin(*VERSIONS), "UnsupportedVersion"),
        (F.col("header_bytes") != HEADER_BYTES, "UnexpectedHeaderBytes"),
    )


def time_error() -> Column:
    return first_of(
        (F.col("stream_type") != TIME, "NotTimeStream"),
        (F.col("ninput") != NINPUT, "UnsupportedNinput"),
        (F.col("payload_format") != INT16, "UnsupportedPayloadFormat"),
        (F.col("payload_bytes") != PAYLOAD_BYTES, "UnexpectedPayloadBytes"),
        (F.col("udp_payload_len") < HEADER_BYTES + F.col("payload_bytes"), "TruncatedTimePayload"),
        # A beat has 128 bytes; a count that reaches behind the payload is refused.
        (F.col("udp_payload_len") < HEADER_BYTES + 128 * F.col("time_count"), "TruncatedTimePayload"),
    )


def _shape(blocks: int, chans: int, times: int) -> Column:
    return (F.col("block_count") == blocks) & (F.col("chan_count") == chans) & (F.col("time_count") == times)


def spec_layout() -> Column:
    """The accepted layout of a spectrum packet, or null."""
    fits = (F.col("nchan") == NCHAN) & (F.col("block_index") < F.col("block_count")) & (F.col("chan0") == F.col("block_index") * F.col("chan_count"))
    fits &= F.col("chan_count") * F.col("time_count") * F.col("ninput") * 4 == PAYLOAD_BYTES
    shape = F.when(_shape(16, 256, 1) & (F.col("pfb_taps") == 0), "27h").when(_shape(16, 256, 1) & (F.col("pfb_taps") >= 4), "27j").when(_shape(64, 64, 4) & (F.col("pfb_taps") >= 4), "27g")
    return F.when(fits, shape)


def layout_matches(layout: str) -> Column:
    """The strict selector: layouts also need their flags. `auto` takes all."""
    flags = F.col("spec_status_flags")
    fft, pfb = flags.bitwiseAND(F.lit(FFT_ONLY)) != 0, flags.bitwiseAND(F.lit(PFB_ACTIVE)) != 0
    return {
        "auto": F.lit(True),
        "27g": _shape(64, 64, 4) & (F.col("pfb_taps") >= 4),
        "27h": _shape(16, 256, 1) & (F.col("pfb_taps") == 0) & fft,
        "27j": _shape(16, 256, 1) & (F.col("pfb_taps") >= 4) & ~fft & pfb,
    }[layout]


def spec_error() -> Column:
    return first_of(
        (F.col("stream_type") != SPEC, "NotSpecStream"),
        (F.col("ninput") != NINPUT, "UnsupportedNinput"),
        (F.col("payload_format") != INT16, "UnsupportedPayloadFormat"),
        (F.col("payload_bytes") != PAYLOAD_BYTES, "UnexpectedPayloadBytes"),
        (F.col("product_id") != PRODUCT, "UnsupportedProduct"),
        (spec_layout().isNull(), "UnexpectedSpecLayout"),
        (F.col("udp_payload_len") < HEADER_BYTES + F.col("payload_bytes"), "TruncatedSpecPayload"),
    )


def classified(df: DataFrame) -> DataFrame:
    """df with error (null: valid) and route: TIME, SPEC, other (an unknown stream) or bad."""
    df = df.withColumn("header_error", header_error())
    of = F.when(F.col("stream_type") == TIME, time_error()).when(F.col("stream_type") == SPEC, spec_error())
    df = df.withColumn("error", F.coalesce("header_error", of)).drop("header_error")
    name = F.when(F.col("stream_type") == TIME, "TIME").when(F.col("stream_type") == SPEC, "SPEC").otherwise("other")
    return df.withColumn("route", F.when(F.col("error").isNotNull(), "bad").otherwise(name))


def valid(df: DataFrame, stream: int) -> DataFrame:
    return classified(df).filter(F.col("error").isNull() & (F.col("stream_type") == stream))


def by_channel_mask(df: DataFrame, mask: int, channel: str = "channel") -> DataFrame:
    return df.filter(F.col(channel).isin(*[c for c in range(64) if mask >> c & 1]))


def with_stream_filter(df: DataFrame, which: str) -> DataFrame:
    """The witness filter: any, spec or time."""
    return df if which == "any" else df.filter(F.col("stream_type") == {"spec": SPEC, "time": TIME}[which])


def first_of_block(df: DataFrame) -> DataFrame:
    """The earliest packet of each block of a frame group; no window, so that a hot group needs no sort."""
    rest = [c for c in df.columns if c not in ("frame_group", "block_index")]
    first = df.groupBy("frame_group", "block_index").agg(F.min(F.struct("seq_no", *[c for c in rest if c != "seq_no"])).alias("r"))
    return first.select("frame_group", "block_index", "r.*")


def freeze_on_event(df: DataFrame, threshold: int, length: int = 256) -> DataFrame:
    """Per channel the first beat of four samples of which the largest part reaches threshold (0 never triggers): the event's
    sample (of equals the first of the beat), its size and its place in the beat, how many of the `length` samples from the
    beat on are there, and overflow: whether a later beat reaches the threshold after they were frozen."""
    size = F.greatest(F.abs("i"), F.abs("q"))
    beats = df.groupBy("channel", F.expr("n div 4").alias("beat")).agg(F.min(F.struct((-size).alias("s"), "n")).alias("m"))
    hits = beats.filter((-F.col("m.s") >= threshold) & F.lit(threshold > 0))
    first = hits.groupBy("channel").agg(F.min(F.struct("beat", "m")).alias("f"), F.max("beat").alias("last"))
    first = first.select("channel", F.col("f.beat").alias("beat"), F.col("f.m.n").alias("event"), (-F.col("f.m.s")).alias("size"), (F.col("last") >= F.col("f.beat") + length // 4).alias("overflow"))
    span = df.select("channel", "n").join(first, "channel").filter((F.col("n") >= F.col("beat") * 4) & (F.col("n") < F.col("beat") * 4 + length))
    return span.groupBy("channel", "event", "size", "overflow").agg(F.count("*").alias("captured")).select("channel", "event", "size", (F.col("event") % 4).alias("lane"), "captured", "overflow")


def q_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, n) for i, n in enumerate(ERRORS)]
    dim = spark.createDataFrame(rows, "code int, error string")
    seen = classified(packets(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("packets"))
    return dim.join(seen, "error", "left").select("code", "error", F.coalesce("packets", F.lit(0)).alias("packets"))


def q_header_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(packets(spark, sf_dir)).groupBy("stream_type", "error", "route").agg(F.count("*").alias("packets"), F.sum("udp_payload_len").alias("bytes"))


def q_spec_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).filter(F.col("stream_type") == SPEC).withColumn("layout", spec_layout())
    hits = [F.count(F.when(layout_matches(x), 1)).alias(f"strict_{x}") for x in ("auto", "27g", "27h", "27j")]
    return df.groupBy("layout").agg(F.count("*").alias("packets"), *hits)


def q_stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir)
    out = [with_stream_filter(df, w).agg(F.count("*").alias("packets"), F.min("seq_no").alias("first_seq")).select(F.lit(w).alias("which"), "packets", "first_seq") for w in ("any", "spec", "time")]
    return out[0].union(out[1]).union(out[2])


def q_channel_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_channel_mask(samples(spark, sf_dir), 0b10100101).groupBy("channel").agg(F.count("*").alias("rows"), F.sum("i").alias("sum_i"))


def q_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("frame_group", (F.col("block_index") % 4).cast("int").alias("block_index"), "seq_no", "board_id")
    return first_of_block(df)


def q_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze_on_event(samples(spark, sf_dir), 32700)


def q_power_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring samples that are both strong enough and one step apart."""
    w = Window.partitionBy("channel").orderBy("n")
    strong = F.col("i").cast("long") * F.col("i") + F.col("q").cast("long") * F.col("q") >= 400_000_000
    df = samples(spark, sf_dir).withColumns({"before": F.lag("n").over(w), "strong": strong}).withColumn("was", F.lag("strong").over(w))
    return df.filter("strong and was and n - before = 1").groupBy("channel").agg(F.count("*").alias("pairs"))


_FIRST = """CASE WHEN magic <> 1412772144 THEN 'BadMagic' WHEN version NOT IN (2, 3) THEN 'UnsupportedVersion' WHEN header_bytes <> 128 THEN 'UnexpectedHeaderBytes'
 WHEN stream_type = 1 THEN CASE WHEN ninput <> 8 THEN 'UnsupportedNinput' WHEN payload_format <> 0 THEN 'UnsupportedPayloadFormat' WHEN payload_bytes <> 8192 THEN 'UnexpectedPayloadBytes' WHEN udp_payload_len < 128 + payload_bytes OR udp_payload_len < 128 + 128 * time_count THEN 'TruncatedTimePayload' END
 WHEN stream_type = 0 THEN CASE WHEN ninput <> 8 THEN 'UnsupportedNinput' WHEN payload_format <> 0 THEN 'UnsupportedPayloadFormat' WHEN payload_bytes <> 8192 THEN 'UnexpectedPayloadBytes' WHEN product_id <> 61697 THEN 'UnsupportedProduct' WHEN layout IS NULL THEN 'UnexpectedSpecLayout' WHEN udp_payload_len < 128 + payload_bytes THEN 'TruncatedSpecPayload' END END"""
_LAYOUT = """CASE WHEN nchan = 4096 AND block_index < block_count AND chan0 = block_index * chan_count AND chan_count * time_count * ninput * 4 = 8192 THEN
 CASE WHEN block_count = 16 AND chan_count = 256 AND time_count = 1 THEN CASE WHEN pfb_taps = 0 THEN '27h' WHEN pfb_taps >= 4 THEN '27j' END WHEN block_count = 64 AND chan_count = 64 AND time_count = 4 AND pfb_taps >= 4 THEN '27g' END END"""
CLASSIFIED = f"""l AS (SELECT *, {_LAYOUT} AS layout FROM packets), x AS (SELECT *, {_FIRST} AS error FROM l),
classified AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'bad' WHEN stream_type = 1 THEN 'TIME' WHEN stream_type = 0 THEN 'SPEC' ELSE 'other' END AS route FROM x)"""


def classified_sql(query: str) -> str:
    return sql("packets", "").strip() + ", " + CLASSIFIED + " " + query


QUERIES = {
    "validate_headers": q_header_errors,
    "error_codes": q_error_codes,
    "spec_layouts": q_spec_layouts,
    "stream_filter": q_stream_filter,
    "channel_mask_filter": q_channel_mask,
    "block_dedup": q_block_dedup,
    "trigger_first": q_trigger,
    "power_gate_pairs": q_power_gate,
}

_names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(ERRORS))
SQL = {
    "validate_headers": classified_sql("SELECT stream_type, error, route, count(*) AS packets, sum(udp_payload_len)::BIGINT AS bytes FROM classified GROUP BY ALL"),
    "error_codes": classified_sql(f"SELECT d.code, d.error, count(c.e) AS packets FROM (VALUES {_names}) d(code, error) LEFT JOIN classified c ON c.error = d.error GROUP BY ALL"),
    "spec_layouts": classified_sql("""SELECT layout, count(*) AS packets, count(*) AS strict_auto, count(*) FILTER (block_count = 64 AND chan_count = 64 AND time_count = 4 AND pfb_taps >= 4) AS strict_27g,
        count(*) FILTER (block_count = 16 AND chan_count = 256 AND time_count = 1 AND pfb_taps = 0 AND spec_status_flags & 256 <> 0) AS strict_27h,
        count(*) FILTER (block_count = 16 AND chan_count = 256 AND time_count = 1 AND pfb_taps >= 4 AND spec_status_flags & 256 = 0 AND spec_status_flags & 1024 <> 0) AS strict_27j
        FROM classified WHERE stream_type = 0 GROUP BY layout"""),
    "stream_filter": sql("packets", "SELECT 'any' AS which, count(*) AS packets, min(seq_no) AS first_seq FROM packets UNION ALL SELECT 'spec', count(*), min(seq_no) FROM packets WHERE stream_type = 0 UNION ALL SELECT 'time', count(*), min(seq_no) FROM packets WHERE stream_type = 1"),
    "channel_mask_filter": sql("samples", 'SELECT channel, count(*) AS "rows", sum(i)::BIGINT AS sum_i FROM samples WHERE (165 >> channel) & 1 = 1 GROUP BY channel'),
    "block_dedup": sql("packets", "SELECT frame_group, (block_index % 4)::INTEGER AS block_index, min(seq_no) AS seq_no, arg_min(board_id, seq_no) AS board_id FROM packets GROUP BY 1, 2"),
    "trigger_first": sql("samples", "").strip() + """, b AS (SELECT channel, n // 4 AS beat, max(greatest(abs(i), abs(q))) AS size, arg_min(n, (-greatest(abs(i), abs(q)), n)) AS event FROM samples GROUP BY 1, 2), h AS (SELECT * FROM b WHERE size >= 32700),
        f AS (SELECT channel, min(beat) AS beat, arg_min(event, beat) AS event, arg_min(size, beat) AS size, max(beat) >= min(beat) + 64 AS overflow FROM h GROUP BY channel)
        SELECT channel, event, size, event % 4 AS lane, count(*) AS captured, overflow FROM f JOIN samples USING (channel) WHERE n >= beat * 4 AND n < beat * 4 + 256 GROUP BY ALL""",
    "power_gate_pairs": sql("samples", """SELECT channel, count(*) AS pairs FROM (SELECT *, i::BIGINT * i + q::BIGINT * q >= 400000000 AS strong, lag(n) OVER w AS before, lag(i::BIGINT * i + q::BIGINT * q >= 400000000) OVER w AS was FROM samples WINDOW w AS (PARTITION BY channel ORDER BY n))
        WHERE strong AND was AND n - before = 1 GROUP BY channel"""),
}
