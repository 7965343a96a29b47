"""Exact fixed-point processing of complex integer samples in long form (n, channel, i, q): sources, decimators, a
half-band filter, requantising, a polyphase filter bank, and counters. All arithmetic is on integers, so every engine
agrees to the bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.functions.bits import names_of, round_half_away, s16, saturate, spread_pairs, unknown_bits
from fluxframe.functions.signal import phase0_word, phase_word
from fluxframe.operators.routes import small
from fluxframe.plans.views import packets, samples, sql

# The half-band filter in Q1.17, by distance from its centre.
HALF_BAND = {0: 65552, 1: 41466, 3: -13128, 5: 7096, 7: -4317, 9: 2690, 11: -1645, 13: 958, 15: -513, 17: 240, 19: -87}
HALF_BAND_DELAY = 20
BLOCK = 1 << 16
# One period of the test tone.
DDS = (0, 1567, 2896, 3784, 4096, 3784, 2896, 1567, 0, -1567, -2896, -3784, -4096, -3784, -2896, -1567)
Q17 = 17


def decimate(df: DataFrame, factor: int, residue: int = 0) -> DataFrame:
    """Every factor-th sample from the epoch on, unfiltered: 8 keeps the first sample of even beats of four."""
    return df.filter(F.pmod(F.col("n"), F.lit(factor)) == residue)


def decimate_beats(df: DataFrame, keep: int) -> DataFrame:
    """Whole beats of four samples, one of `keep`."""
    return df.filter(F.pmod(F.floor(F.col("n") / 4), F.lit(keep)) == 0)


def rounded_q17(acc: Column) -> Column:
    return saturate(round_half_away(acc, Q17), 16).cast("int")


def half_band(df: DataFrame) -> DataFrame:
    """Decimation by two behind the half-band filter. A sample has an output once all samples from 20 before it to 19
    after it are there, which is first at n = 20; sample0 is counted from there. Channels are cut into blocks of BLOCK places,
    to which the HALF_BAND_DELAY samples before and after are lent, so that a channel is as many tasks as it has blocks. A
    filter runs over neighbouring rows: where samples are missing, over those next to the hole."""
    w = Window.partitionBy("channel", "_block").orderBy("n")
    own = F.floor(F.col("n") / BLOCK)
    lent = F.array_distinct(F.array(own, F.floor((F.col("n") - HALF_BAND_DELAY) / BLOCK), F.floor((F.col("n") + HALF_BAND_DELAY) / BLOCK)))
    df = df.select("channel", "n", "i", "q", own.alias("_own"), F.explode(lent).alias("_block"))

    def filtered(c: str) -> Column:
        x = F.col(c).cast("long")
        pair = lambda k: F.lag(x, k).over(w) + F.lead(x, k).over(w)
        return sum((pair(k) * v for k, v in HALF_BAND.items() if k), x * HALF_BAND[0])

    df = df.withColumns({"_i": filtered("i"), "_q": filtered("q"), "_back": F.lag("n", HALF_BAND_DELAY).over(w)})
    df = df.filter((F.col("_own") == F.col("_block")) & (F.pmod(F.col("n"), F.lit(2)) == 0) & F.col("_i").isNotNull() & F.col("_back").isNotNull())
    return df.select("channel", "n", rounded_q17(F.col("_i")).alias("i"), rounded_q17(F.col("_q")).alias("q"))


def requantise(df: DataFrame, bits: int = 8) -> DataFrame:
    """Saturation to fewer bits, and whether that changed the sample."""
    i, q = saturate(F.col("i"), bits), saturate(F.col("q"), bits)
    return df.select("channel", "n", i.alias("i"), q.alias("q"), ((i != F.col("i")) | (q != F.col("q"))).alias("clipped"))


def pfb_coefficients(nchan: int = 4096, taps: int = 4) -> list[int]:
    """Tap-major coefficients in Q1.17: a sinc under a Hamming window, each phase scaled to sum to 1; what rounding leaves
    over goes to the phase's largest coefficient, the earlier tap on a tie."""
    total, one = nchan * taps, 1 << Q17
    out = [0] * total
    for phase in range(nchan):
        places = [t * nchan + phase for t in range(taps)]
        shape = []
        for p in places:
            x = math.pi * (p - (total - 1) / 2) / nchan
            shape.append((math.sin(x) / x if abs(x) > 1e-15 else 1.0) * (0.54 - 0.46 * math.cos(2 * math.pi * p / (total - 1))))
        scale = one / sum(shape)
        for p, v in zip(places, shape, strict=True):
            out[p] = max(-one, min(one - 1, round(v * scale)))
        left = one - sum(out[p] for p in places)
        for t in sorted(range(taps), key=lambda t: -abs(shape[t])):
            give = max(-one, min(one - 1, out[places[t]] + left)) - out[places[t]]
            out[places[t]] += give
            left -= give
    return out


def pfb(df: DataFrame, coefficients: DataFrame, nchan: int, taps: int = 4) -> DataFrame:
    """The filter bank's sums: per channel, frame and phase the last `taps` frames, the oldest at tap 0. coefficients
    (phase, c: array of taps) has nchan rows, 4096 at most. Frames without all predecessors have no output."""
    df = df.withColumns({"frame": F.floor(F.col("n") / nchan), "phase": (F.col("n") % nchan).cast("int")})
    w = Window.partitionBy("channel", "phase").orderBy("frame")
    df = df.join(small(coefficients, 4096), "phase")
    tap = lambda c: sum((F.lag(F.col(c).cast("long"), taps - 1 - t).over(w) * F.get("c", F.lit(t)) for t in range(1, taps)), F.lag(F.col(c).cast("long"), taps - 1).over(w) * F.get("c", F.lit(0)))
    df = df.withColumns({"_i": tap("i"), "_q": tap("q"), "_from": F.lag("frame", taps - 1).over(w)}).filter(F.col("frame") - F.col("_from") == taps - 1)
    return df.select("channel", "frame", "phase", rounded_q17(F.col("_i")).alias("i"), rounded_q17(F.col("_q")).alias("q"))


def rotated(df: DataFrame) -> DataFrame:
    """The channeliser's simulation model: bin n of lane channel turned by (n + channel) mod 4 quarter turns."""
    k = F.pmod(F.col("n") + F.col("channel"), F.lit(4))
    i, q = F.col("i"), F.col("q")
    return df.select("channel", "n", s16(F.when(k == 0, i).when(k == 1, -q).when(k == 2, -i).otherwise(q)).alias("i"), s16(F.when(k == 0, q).when(k == 1, i).when(k == 2, -q).otherwise(-i)).alias("q"))


def monitor(df: DataFrame) -> DataFrame:
    """Per channel samples, full-scale hits and the sum of absolute parts modulo 2 ** 32; abs(-32768) is 32768."""
    rail = F.col("i").isin(-32768, 32767) | F.col("q").isin(-32768, 32767)
    return df.groupBy("channel").agg(F.count("*").alias("samples"), F.count(F.when(rail, 1)).alias("rail_hits"), F.pmod(F.sum(F.abs(F.col("i").cast("long")) + F.abs(F.col("q").cast("long"))), F.lit(1 << 32)).alias("magnitude"))


def peak_cells(df: DataFrame) -> DataFrame:
    """The bin of the largest sum of absolute parts over all channels; of equal sums the last bin."""
    metric = df.groupBy("bin").agg(F.sum(F.abs(F.col("i").cast("long")) + F.abs(F.col("q").cast("long"))).alias("metric"))
    return metric.agg(F.max(F.struct("metric", "bin")).alias("m")).select("m.bin", "m.metric")


def tones(places: DataFrame, channels: list[dict], rate_hz: float) -> DataFrame:
    """n, channel, i, q at places (n, channel) of numerically controlled oscillators: a 32-bit phase, a quarter-wave table of
    512 values, and an amplitude in Q15. channels, 64 at most: frequency_hz, phase_deg, amplitude, mode (tone, const or zero)."""
    if len(channels) > 64:
        raise ValueError("at most 64 channels")
    spark = places.sparkSession
    table_ = F.array(*[F.lit(int(math.floor(32767 * math.sin(math.pi / 2 * k / 511) + 0.5))) for k in range(512)])
    spec = spark.createDataFrame([(k, float(c["frequency_hz"]), float(c.get("phase_deg", 0)), int(c["amplitude"]), c.get("mode", "tone")) for k, c in enumerate(channels)], "channel int, f double, p double, amplitude int, mode string")
    df = places.select("n", "channel").join(F.broadcast(spec), "channel")
    step = F.when(F.col("mode") == "const", F.lit(0).cast("long")).otherwise(phase_word(F.col("f"), rate_hz))
    base = phase0_word(F.col("p"))

    def sine(phase: Column) -> Column:
        phase = F.pmod(phase, F.lit(1 << 32))
        quadrant, index = F.shiftright(phase, 30), F.shiftright(phase, 21).bitwiseAND(F.lit(511)).cast("int")
        size = F.get(table_, F.when(quadrant % 2 == 0, index).otherwise(511 - index))
        return F.when(F.col("mode") == "zero", 0).otherwise(F.shiftright(F.when(quadrant >= 2, -size).otherwise(size) * F.col("amplitude"), 15))

    phase = F.pmod(F.col("n") * step, F.lit(1 << 32)) + base
    return df.select("n", "channel", sine(phase).cast("int").alias("i"), sine(phase + (1 << 30)).cast("int").alias("q"))


def dds(df: DataFrame) -> DataFrame:
    """The 16-step test tone of beat words: phase advances by a quarter turn a beat, lanes and channels shift it."""
    phase = F.pmod(F.floor(F.col("n") / 4) * (1 << 30) + (F.col("n") % 4) * (1 << 28) + F.col("channel") * (1 << 24), F.lit(1 << 32))
    k = F.shiftright(phase, 28).cast("int")
    sine = F.array(*map(F.lit, DDS))
    return df.select("n", "channel", F.get(sine, k).alias("i"), F.get(sine, (k + 4) % 16).alias("q"))


def ramp(df: DataFrame) -> DataFrame:
    """The counting test pattern; q is i with its highest bit turned."""
    v = F.pmod(F.col("n") + F.col("channel") * 256, F.lit(65536))
    return df.select("n", "channel", s16(v).alias("i"), s16(v.bitwiseXOR(F.lit(0x8000))).alias("q"))


def adapted(df: DataFrame, mask: int, hold: bool = False) -> DataFrame:
    """Converter samples: channels outside the mask, or all while a diagnostic holds them, are 0."""
    on = F.lit(not hold) & F.col("channel").isin(*[c for c in range(8) if mask >> c & 1])
    return df.select("channel", "n", F.when(on, F.col("i")).otherwise(0).alias("i"), F.when(on, F.col("q")).otherwise(0).alias("q"))


def spaced(df: DataFrame, every: int) -> DataFrame:
    """Low-rate packets: one of `every` is sent, the others count as dropped."""
    sent = F.pmod(F.col("seq_no"), F.lit(every)) == 0
    return df.groupBy("flow_id").agg(F.count(F.when(sent, 1)).alias("sent"), F.count(F.when(~sent, 1)).alias("dropped"), F.min(F.when(sent, F.col("sample0"))).alias("first_sample0"))


PFB_TEST = 16


def _pfb_test(spark: SparkSession) -> DataFrame:
    c = pfb_coefficients(PFB_TEST)
    return spark.createDataFrame([(p, [c[t * PFB_TEST + p] for t in range(4)]) for p in range(PFB_TEST)], "phase int, c array<long>")


def _q(f):
    return lambda spark, sf_dir: f(samples(spark, sf_dir))


def q_pfb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfb(samples(spark, sf_dir), _pfb_test(spark), PFB_TEST)


def q_pfb_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default table's sum, count and range, checked by Spark."""
    c = spark.createDataFrame([(p, x) for p, x in enumerate(pfb_coefficients())], "p long, c long")
    by_place = F.sum(F.col("c") * (F.col("p") % 4096 % 97 + F.expr("p div 4096"))).alias("by_place")
    return c.agg(F.pmod(F.sum("c"), F.lit(1 << 32)).alias("checksum"), F.count("*").alias("n"), ((F.count("*") == 16384) & (F.min("c") >= -131072) & (F.max("c") <= 131071)).alias("ok"), by_place)


# The half-band filter's contract.
PASS_HZ, STOP_HZ, SWEEP, MOST_RIPPLE_DB, LEAST_STOP_DB, TAPS = 50e6, 72.88e6, 2001, 0.25, 55.0, 41


def filter_contract(spark: SparkSession, taps: dict[int, int], rate_hz: float = 245.76e6) -> DataFrame:
    """Of a symmetric filter in Q1.17 (by distance from its centre): taps, sum, ripple of the pass band and attenuation of the
    stop band over SWEEP even steps each, and whether it keeps the contract."""
    gain = lambda hz: F.abs(sum(F.lit(float(c if k == 0 else 2 * c)) * F.cos(2 * math.pi * hz * k / rate_hz) for k, c in taps.items()) / float(1 << Q17))
    at = spark.range(SWEEP).select((F.col("id") * PASS_HZ / (SWEEP - 1)).alias("low"), (STOP_HZ + F.col("id") * (rate_hz / 2 - STOP_HZ) / (SWEEP - 1)).alias("high"))
    db = lambda c: 20 * F.log10(F.greatest(gain(F.col(c)), F.lit(1e-15)))
    size, total = 2 * max(taps) + 1 + 2 * (max(taps) % 2), taps[0] + 2 * sum(c for k, c in taps.items() if k)
    out = at.agg((F.max(db("low")) - F.min(db("low"))).alias("ripple_db"), (-F.max(db("high"))).alias("stop_db"))
    ok = (F.col("ripple_db") <= MOST_RIPPLE_DB) & (F.col("stop_db") >= LEAST_STOP_DB) & F.lit(total == 1 << Q17) & F.lit(size == TAPS)
    return out.select("ripple_db", "stop_db", F.lit(total).alias("dc_sum"), F.lit(size).alias("taps"), ok.alias("ok"))


def q_half_band_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_contract(spark, HALF_BAND).withColumns({c: F.round(c, 6) for c in ("ripple_db", "stop_db")})


def q_peak_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_cells(samples(spark, sf_dir).withColumn("bin", F.col("n") % 64))


def q_counts_decimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = F.floor(F.col("n") / 4)
    return samples(spark, sf_dir).groupBy("channel").agg(*[F.count(F.when(F.pmod(beat, F.lit(k)) == 0, 1)).alias(f"kept_{k}") for k in (4, 32, 64)], F.count("*").alias("offered"))


def q_tone_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = [{"frequency_hz": 1e6 * k, "phase_deg": 45 * k, "amplitude": 4000 * k, "mode": ("tone", "const", "zero")[k % 3]} for k in range(8)]
    return tones(samples(spark, sf_dir), channels, 245.76e6)


def q_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit masks: doubled for physical lanes, as names, and what has no name."""
    names = {0: "clock", 1: "lock", 3: "pps", 6: "overflow"}
    m = (F.col("e") % 256).cast("int")
    return packets(spark, sf_dir).select("e", spread_pairs(m).alias("lanes"), F.array_join(names_of(m, names), ",").alias("names"), unknown_bits(m, names).alias("unknown"))


def q_backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-water mark and stalls of a queue of 12 that fills with each packet and drains two an hour's packet, by board."""
    depth = (F.col("e") * 7 % 16).cast("int")
    return packets(spark, sf_dir).groupBy("board_id").agg(F.max(F.least(depth, F.lit(12))).alias("high_water"), F.count(F.when(depth > 12, 1)).alias("stalled"), F.count(F.when((depth > 12) & (F.col("stream_type") == 0), 1)).alias("dropped_spec"), F.count(F.when((depth > 12) & (F.col("stream_type") == 1), 1)).alias("dropped_time"))


def q_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced(packets(spark, sf_dir), 24)


QUERIES = {
    "fir41_decim2": _q(half_band), "decim8": _q(lambda d: decimate(d, 8)), "decim2_legacy": _q(lambda d: decimate(d, 2)), "beat_keep1of32": _q(lambda d: decimate_beats(d, 32)), "decimator_counts": q_counts_decimator,
    "requant_int8": _q(requantise), "pfb4_sum": q_pfb, "pfb_checksum": q_pfb_checksum, "half_band_contract": q_half_band_check, "fft_model_rotate": _q(rotated),
    "monitor_counters": _q(monitor), "peak_last": q_peak_last, "tone_bank": q_tone_bank, "dds_source": _q(dds), "ramp_source": _q(ramp), "adc_adapter": _q(lambda d: adapted(d, 0b01101101)),
    "lane_masks": q_masks, "backpressure": q_backpressure, "packet_spacing": q_spacing,
}


def _fir_sql(c: str) -> str:
    return f"{c}::BIGINT * 65552 + " + " + ".join(f"(lag({c}, {k}) OVER w + lead({c}, {k}) OVER w)::BIGINT * ({v})" for k, v in HALF_BAND.items() if k)


def _round_sql(x: str) -> str:
    return f"greatest(-32768, least(32767, CASE WHEN {x} < 0 THEN -((-({x}) + 65536) >> 17) ELSE ({x} + 65536) >> 17 END))::INTEGER"


_C = pfb_coefficients(PFB_TEST)
_PFB = ", ".join(f"({p}, {', '.join(str(_C[t * PFB_TEST + p]) for t in range(4))})" for p in range(PFB_TEST))
_SINE = "[" + ", ".join(map(str, DDS)) + "]"
_RAIL = "i IN (-32768, 32767) OR q IN (-32768, 32767)"


def _s16_sql(x: str) -> str:
    return f"(((({x}) + 32768) & 65535) - 32768)::INTEGER"


def tones_sql(hz: str, degrees: str, amplitude: str, mode: str) -> str:
    """tones(n, channel, i, q): oscillators at the places of samples, by the channel's number c; modes 0 tone, 1 constant, 2 zero."""
    return f"""t AS (SELECT n, c::INTEGER AS channel, {mode} AS mode, (n * CASE WHEN {mode} = 1 THEN 0 ELSE round_even(({hz}) / 245.76e6 * 4294967296, 0)::BIGINT END) % 4294967296 + round_even(({degrees}) / 360 * 4294967296, 0)::BIGINT AS p, {amplitude} AS a FROM (SELECT n, channel AS c FROM samples)),
        u AS (SELECT *, unnest([0, 1]) AS part FROM t), v AS (SELECT *, (p + part * 1073741824) % 4294967296 AS ph FROM u),
        w AS (SELECT *, ph >> 30 AS quad, (ph >> 21) & 511 AS k FROM v),
        x AS (SELECT *, floor(32767 * sin(pi() / 2 * CASE WHEN quad % 2 = 0 THEN k ELSE 511 - k END / 511) + 0.5)::BIGINT AS size FROM w),
        y AS (SELECT *, CASE WHEN mode = 2 THEN 0 ELSE floor(CASE WHEN quad >= 2 THEN -size ELSE size END * a / 32768)::INTEGER END AS v FROM x),
        tones AS (SELECT n, channel, max(v) FILTER (part = 0) AS i, max(v) FILTER (part = 1) AS q FROM y GROUP BY n, channel)"""


# The filter bank's coefficients from their rule: what rounding leaves goes to each phase's largest one, the earlier on a tie.
_TAPS = """shape AS (SELECT phase, tap, x, (CASE WHEN abs(x) > 1e-15 THEN sin(x) / x ELSE 1.0 END) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * p / 16383)) AS s FROM (SELECT p % 4096 AS phase, p // 4096 AS tap, p, pi() * (p - 16383 / 2.0::DOUBLE) / 4096 AS x FROM (SELECT unnest(range(16384)) AS p))),
    whole AS (SELECT phase, tap, s, greatest(-131072, least(131071, round_even(s * (131072 / sum(s) OVER (PARTITION BY phase)), 0)))::BIGINT AS c FROM shape),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY abs(s) DESC, tap) AS place, 131072 - sum(c) OVER (PARTITION BY phase) AS over FROM whole),
    taps AS (SELECT phase, tap, c + CASE place WHEN 1 THEN least(over, 131071 - c) WHEN 2 THEN over - least(over, 131071 - max(c) FILTER (place = 1) OVER (PARTITION BY phase)) ELSE 0 END AS c FROM ranked)"""

SQL = {
    "fir41_decim2": sql("samples", f"SELECT channel, n, {_round_sql('a')} AS i, {_round_sql('b')} AS q FROM (SELECT channel, n, lag(n, 20) OVER w AS back, {_fir_sql('i')} AS a, {_fir_sql('q')} AS b FROM samples WINDOW w AS (PARTITION BY channel ORDER BY n)) WHERE n % 2 = 0 AND a IS NOT NULL AND back IS NOT NULL"),
    "decim8": sql("samples", "SELECT n, channel, i, q FROM samples WHERE n % 8 = 0"),
    "decim2_legacy": sql("samples", "SELECT n, channel, i, q FROM samples WHERE n % 2 = 0"),
    "beat_keep1of32": sql("samples", "SELECT n, channel, i, q FROM samples WHERE (n // 4) % 32 = 0"),
    "decimator_counts": sql("samples", "SELECT channel, " + ", ".join(f"count(*) FILTER ((n // 4) % {k} = 0) AS kept_{k}" for k in (4, 32, 64)) + ", count(*) AS offered FROM samples GROUP BY channel"),
    "requant_int8": sql("samples", "SELECT channel, n, greatest(-128, least(127, i)) AS i, greatest(-128, least(127, q)) AS q, i NOT BETWEEN -128 AND 127 OR q NOT BETWEEN -128 AND 127 AS clipped FROM samples"),
    "pfb4_sum": sql("samples", f"""SELECT channel, frame, phase, {_round_sql('a')} AS i, {_round_sql('b')} AS q FROM (
        SELECT channel, frame, phase::INTEGER AS phase, frame - lag(frame, 3) OVER w AS span, {' + '.join(f'lag(i, {3 - t}) OVER w::BIGINT * c{t}' if t < 3 else 'i::BIGINT * c3' for t in range(4))} AS a, {' + '.join(f'lag(q, {3 - t}) OVER w::BIGINT * c{t}' if t < 3 else 'q::BIGINT * c3' for t in range(4))} AS b
        FROM (SELECT *, n // {PFB_TEST} AS frame, n % {PFB_TEST} AS phase FROM samples) JOIN (VALUES {_PFB}) c(phase, c0, c1, c2, c3) USING (phase) WINDOW w AS (PARTITION BY channel, phase ORDER BY frame)) WHERE span = 3"""),
    "pfb_checksum": "WITH " + _TAPS + " SELECT (sum(c) % 4294967296)::BIGINT AS checksum, count(*) AS n, count(*) = 16384 AND min(c) >= -131072 AND max(c) <= 131071 AS ok, sum(c * (phase % 97 + tap))::BIGINT AS by_place FROM taps",
    # the taps written out in full, with the zeros between and at both ends
    "half_band_contract": "WITH c AS (SELECT unnest(range(41)) - 20 AS k, unnest([" + ", ".join(str(HALF_BAND.get(abs(k), 0)) for k in range(-20, 21)) + """]) AS c),
        f AS (SELECT 50e6 * i / 2000 AS hz, true AS pass FROM range(2001) t(i) UNION ALL SELECT 72.88e6 + (245.76e6 / 2 - 72.88e6) * i / 2000, false FROM range(2001) t(i)),
        g AS (SELECT hz, pass, 20 * log10(greatest(sqrt(sum(c / 131072 * cos(2 * pi() * hz / 245.76e6 * k)) ** 2 + sum(c / 131072 * sin(2 * pi() * hz / 245.76e6 * k)) ** 2), 1e-15)) AS db FROM f, c GROUP BY hz, pass),
        r AS (SELECT max(db) FILTER (pass) - min(db) FILTER (pass) AS ripple_db, -max(db) FILTER (NOT pass) AS stop_db FROM g), t AS (SELECT sum(c)::INTEGER AS dc_sum, count(*)::INTEGER AS taps FROM c)
        SELECT round(ripple_db, 6) AS ripple_db, round(stop_db, 6) AS stop_db, dc_sum, taps, ripple_db <= 0.25 AND stop_db >= 55 AND dc_sum = 131072 AND taps = 41 AS ok FROM r, t""",
    "fft_model_rotate": sql("samples", f"SELECT channel, n, {_s16_sql('CASE k WHEN 0 THEN i WHEN 1 THEN -q WHEN 2 THEN -i ELSE q END')} AS i, {_s16_sql('CASE k WHEN 0 THEN q WHEN 1 THEN i WHEN 2 THEN -q ELSE -i END')} AS q FROM (SELECT *, (n + channel) % 4 AS k FROM samples)"),
    "monitor_counters": sql("samples", f"SELECT channel, count(*) AS samples, count(*) FILTER ({_RAIL}) AS rail_hits, (sum(abs(i::BIGINT) + abs(q::BIGINT)) % 4294967296)::BIGINT AS magnitude FROM samples GROUP BY channel"),
    "peak_last": sql("samples", "SELECT bin, metric FROM (SELECT n % 64 AS bin, sum(abs(i::BIGINT) + abs(q::BIGINT))::BIGINT AS metric FROM samples GROUP BY 1) ORDER BY metric DESC, bin DESC LIMIT 1"),
    "tone_bank": sql("samples", "").strip() + ", " + tones_sql("1e6 * c", "45 * c", "4000 * c", "c % 3") + " SELECT * FROM tones",
    "dds_source": sql("samples", f"SELECT n, channel, {_SINE}[k + 1] AS i, {_SINE}[(k + 4) % 16 + 1] AS q FROM (SELECT n, channel, (((n // 4) * 1073741824 + (n % 4) * 268435456 + channel * 16777216) % 4294967296) >> 28 AS k FROM samples)"),
    "ramp_source": sql("samples", f"SELECT n, channel, {_s16_sql('v')} AS i, {_s16_sql('xor(v, 32768)')} AS q FROM (SELECT n, channel, (n + channel * 256) % 65536 AS v FROM samples)"),
    "adc_adapter": sql("samples", "SELECT channel, n, CASE WHEN (109 >> channel) & 1 = 1 THEN i ELSE 0 END AS i, CASE WHEN (109 >> channel) & 1 = 1 THEN q ELSE 0 END AS q FROM samples"),
    "lane_masks": sql("packets", "SELECT e, (" + " + ".join(f"((m >> {k}) & 1) * {3 * 4**k}" for k in range(8)) + ")::INTEGER AS lanes, concat_ws(',', CASE WHEN m & 1 = 1 THEN 'clock' END, CASE WHEN m & 2 = 2 THEN 'lock' END, CASE WHEN m & 8 = 8 THEN 'pps' END, CASE WHEN m & 64 = 64 THEN 'overflow' END) AS names, (m & ~75)::INTEGER AS unknown FROM (SELECT e, e % 256 AS m FROM packets)"),
    "backpressure": sql("packets", "SELECT board_id, max(least(e * 7 % 16, 12))::INTEGER AS high_water, count(*) FILTER (e * 7 % 16 > 12) AS stalled, count(*) FILTER (e * 7 % 16 > 12 AND stream_type = 0) AS dropped_spec, count(*) FILTER (e * 7 % 16 > 12 AND stream_type = 1) AS dropped_time FROM packets GROUP BY board_id"),
    "packet_spacing": sql("packets", "SELECT flow_id, count(*) FILTER (seq_no % 24 = 0) AS sent, count(*) FILTER (seq_no % 24 <> 0) AS dropped, min(sample0) FILTER (seq_no % 24 = 0) AS first_sample0 FROM packets GROUP BY flow_id"),
}
