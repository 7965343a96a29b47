"""Composite analyses: phase views of captures, waveforms, raw spectra, two-tone fits, kernel joins, versions of tables and
settings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.functions.signal import rf_equivalent, wrap_degrees
from fluxframe.operators.dsp import tones_sql
from fluxframe.operators.ordered import SPAN, previous, running
from fluxframe.operators.spectrum import TONE, _over, _PROJ, _r, _wrap, channel_statistics, coherent_phase, projection, spectra, spectrum_sql, square, to_reference, unwrapped
from fluxframe.plans.views import captures, packets, samples, sql, stepped
from fluxframe.streaming.receiver import run_batch


def aligned_phase(df: DataFrame, key: str, channel: str, cycles_per_sample: float, configured: Column, anchor_deg: float, reference: int) -> DataFrame:
    """Captures' phases moved to the epoch: measured, aligned, their error against the configured phase and the anchor, and
    the difference to the reference channel. df has key, channel, sample0, n, i, q."""
    meta = df.groupBy("capture").agg(F.first(key).alias(key), F.first(channel).alias(channel), F.min("sample0").alias("sample0"))
    out = projection(df, "capture", cycles_per_sample).join(meta, "capture").withColumn("aligned_deg", coherent_phase(F.col("phase_deg"), F.col("sample0"), cycles_per_sample))
    out = out.withColumn("error_deg", wrap_degrees(F.col("aligned_deg") - configured - anchor_deg))
    return to_reference(out, key, channel, "aligned_deg", reference)


def provenance(df: DataFrame, rate_hz: float, cycles_per_sample: float, configured_deg: Column) -> DataFrame:
    """Per capture the configured phase, the measured one, the one moved to the epoch, and the strongest frequency, apart."""
    tone = projection(df, "capture", cycles_per_sample).withColumn("coherent_deg", coherent_phase(F.col("phase_deg"), F.col("capture") * 5, cycles_per_sample))
    s = spectra(df, "capture", rate_hz, "provenance").groupBy("capture").agg(F.min(F.struct((-F.round("dbfs", 6)).alias("d"), "bin", "frequency_hz")).alias("m"))
    return tone.join(s, "capture").select("capture", configured_deg.alias("configured_deg"), F.col("phase_deg").alias("measured_deg"), "coherent_deg", F.col("m.frequency_hz").alias("peak_hz"), "residual")


def raw_spectrum(df: DataFrame, key: str, rate_hz: float, size: int | None = None) -> DataFrame:
    """Amplitudes of a transform without window over each capture's samples (or those at the first `size` places), with the
    bin that a one-sided display shows. Only these are gathered, one capture a group."""
    if size:
        first = df.groupBy(key).agg(F.min("n").alias("_first"))
        df = df.join(first, key).filter(F.col("n") < F.col("_first") + size)

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x = np.fft.fft(pdf["i"].to_numpy(float) + 1j * pdf["q"].to_numpy(float)) / len(pdf)
        b = np.arange(len(x))
        return pd.DataFrame({key: k[0], "bin": b.astype(np.int32), "display_bin": np.minimum(b, len(x) - b).astype(np.int32), "frequency_hz": np.fft.fftfreq(len(x), 1 / rate_hz), "amplitude": np.abs(x)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "n", "i", "q").groupBy(key).applyInPandas(one, f"{key} {kind}, bin int, display_bin int, frequency_hz double, amplitude double")


def payload_metrics(df: DataFrame, rate_hz: float, cycles_per_sample: float, configured_deg: Column, anchor_deg: float = 0.0) -> DataFrame:
    """What a captured payload (capture, sample0, n, i, q) tells of its tone: the phase measured, moved to the epoch and against
    the configured one and the anchor; amplitude, rms and largest part; what the tone leaves, as rms, share and dB; the
    strongest frequency between bins and its ratio to the median of the others; and whether it is clipped."""
    base = df.groupBy("capture").agg(F.min("sample0").alias("sample0"), F.count("*").alias("samples"), F.sqrt(F.avg(square().cast("double"))).alias("rms"), F.max(F.greatest(F.abs("i"), F.abs("q"))).alias("largest"))
    tone = projection(df, "capture", cycles_per_sample)
    s = spectra(df, "capture", rate_hz, "payload").withColumn("power", F.pow(F.lit(10.0), F.col("dbfs") / 10))
    top = s.groupBy("capture").agg(F.min(F.struct((-F.round("dbfs", 6)).alias("d"), "bin")).alias("m"), F.count("*").alias("size")).select("capture", F.col("m.bin").alias("peak"), "size")
    s = s.join(top, "capture")
    at = lambda k: F.max(F.when(F.col("bin") == F.col("peak") + k, F.col("dbfs")))
    guard = F.greatest(F.lit(2), F.floor(F.col("size") / 128))
    s = s.groupBy("capture").agg(F.max(F.when(F.col("bin") == F.col("peak"), F.col("frequency_hz"))).alias("hz"), at(-1).alias("a"), at(0).alias("b"), at(1).alias("c"), F.max("size").alias("size"), F.percentile(F.when(F.abs(F.col("bin") - F.col("peak")) > guard, F.col("dbfs")), F.lit(0.5)).alias("noise"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    shift = F.when(F.col("a").isNull() | F.col("c").isNull() | (bend == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("a") - F.col("c")) / 2 / bend)))
    s = s.select("capture", (F.col("hz") + shift * rate_hz / F.col("size")).alias("peak_hz"), (F.col("b") - F.col("noise")).alias("snr_db"))
    out = base.join(tone, "capture").join(s, "capture").withColumn("aligned_deg", coherent_phase(F.col("phase_deg"), F.col("sample0"), cycles_per_sample))
    return out.withColumns({"error_deg": wrap_degrees(F.col("aligned_deg") - configured_deg - anchor_deg), "clipped": F.col("largest") >= 32760})


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path by name: name, bytes, sha256, sha1. Spark's source passes over empty files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1")).orderBy("name")


class CoefficientBank:
    """A double-buffered coefficient table, as a machine over its commands: start (refused while enabled, or unless four taps are
    asked for), write (refused unless loading), abort, and commit (refused while enabled or before the table is full). A commit
    puts the loaded table in force; a refusal sets an error and counts it. Checksums are sums modulo 2 ** 32."""

    START = {"loading": False, "full": False, "loaded": 0, "sum": 0, "id": None, "bank": 0, "active_id": None, "active_sum": None, "error": False, "errors": 0}

    def __init__(self, size: int = 16384, taps: int = 4, state: dict | None = None) -> None:
        self.size, self.taps = size, taps
        self.s = state or dict(self.START)

    def feed(self, e: dict) -> list[dict]:
        s, what = self.s, e["command"]
        refused = {"start": e["enabled"] or e["taps"] != self.taps, "write": not s["loading"], "commit": e["enabled"] or not s["full"]}.get(what, False)
        if refused:
            s.update(error=True, errors=s["errors"] + 1)
        elif what == "start":
            s.update(loading=True, full=False, loaded=0, sum=0, id=e["id"], error=False)
        elif what == "abort":
            s.update(loading=False, full=False)
        elif what == "write":
            s.update(loaded=s["loaded"] + 1, sum=(s["sum"] + e["value"]) % (1 << 32), full=s["full"] or s["loaded"] + 1 == self.size)
        elif what == "commit":
            s.update(loading=False, full=False, bank=1 - s["bank"], active_id=s["id"], active_sum=s["sum"], error=False)
        return [{"e": e["e"], "active_id": s["active_id"], "active_sum": s["active_sum"], "error": s["error"], "errors": s["errors"]}]


def patched(config: DataFrame, patches: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Each configuration (key, generation, fields) after its patches (key, order, fields, null: as it was): the last value given
    to each field, a generation more for each patch, and cleared: whether previews shown before are to go."""
    last = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields]
    p = patches.groupBy(key).agg(F.count("*").alias("_n"), *last)
    out = config.join(p, key, "left").withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields})
    return out.withColumns({"generation": F.col("generation") + F.coalesce("_n", F.lit(0)), "cleared": F.coalesce("_n", F.lit(0)) > 0}).drop("_n", *(f"_{f}" for f in fields))


def two_tones(df: DataFrame, key: str, a: float, b: float) -> DataFrame:
    """Share of the power of i that cosines and sines of one frequency and a constant explain, for two frequencies; the
    better one's number. Sums and the closed form of a fit of two columns."""
    out = None
    for c in (a, b):
        t = 2 * math.pi * F.pmod(F.col("n") * c, F.lit(1.0))
        x, y, v = F.cos(t), F.sin(t), F.col("i").cast("double")
        s = df.groupBy(key).agg(F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"), F.sum(x * v).alias("xv"), F.sum(y * v).alias("yv"), F.sum(v * v).alias("vv"))
        det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
        p, q = (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det, (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det
        share = F.when((F.col("vv") > 0) & (F.abs(det) > 1e-9), (p * F.col("xv") + q * F.col("yv")) / F.col("vv")).otherwise(F.lit(0.0))
        s = s.select(key, share.alias("share_a" if out is None else "share_b"))
        out = s if out is None else out.join(s, key)
    return out.withColumn("better", F.when(F.col("share_a") >= F.col("share_b"), 0).otherwise(1))


def source_phase(df: DataFrame, key: str, cycles_per_sample: float) -> DataFrame:
    """Amplitude's and phase's range of a generated tone: phases less the tone's own turn, without jumps."""
    t = 360 * F.pmod(F.col("n") * cycles_per_sample, F.lit(1.0))
    turn = F.radians(wrap_degrees(F.degrees(F.atan2(F.col("q").cast("double"), F.col("i").cast("double"))) - t))
    x = unwrapped(df.withColumn("turn", turn), key, "n", "turn")
    size = F.hypot(F.col("i").cast("double"), F.col("q").cast("double"))
    return x.groupBy(key).agg(F.degrees(F.max("unwrapped") - F.min("unwrapped")).alias("phase_range_deg"), (F.max(size) - F.min(size)).alias("amplitude_range"), F.avg(size).alias("amplitude"))


def kernel_join(points: DataFrame, grid: DataFrame, key: str, radius: int = 12) -> DataFrame:
    """Band-limited values at points (key, at) from a grid (key, n, i, q): a range join |at - n| < radius by blocks of
    2 * radius, so it is an equality join of at most two blocks a point."""
    block = 2 * radius
    p = points.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("at") - radius) / block), F.floor((F.col("at") + radius) / block)))))
    x = p.join(grid.withColumn("_b", F.floor(F.col("n") / block)), [key, "_b"])
    d = F.col("at") - F.col("n")
    sinc = lambda v: F.when(F.abs(v) < 1e-12, F.lit(1.0)).otherwise(F.sin(math.pi * v) / (math.pi * v))
    x = x.filter(F.abs(d) < radius).withColumns({"k": sinc(d) * sinc(d / radius), "_d": F.abs(d)})
    own = lambda c: F.max(F.when(F.col("_d") < 1e-9, F.col(c)))  # noqa: E731  the sample itself, where there is one
    near = lambda c: F.min_by(c, F.struct("_d", "n"))
    value = lambda c: F.coalesce(own(c).cast("double"), F.when(F.abs(F.sum("k")) > 1e-9, F.sum(F.col("k") * F.col(c)) / F.sum("k")), near(c).cast("double"))
    return x.groupBy(key, "at").agg(value("i").alias("i"), value("q").alias("q"), F.count("*").alias("taps"))


def segments(df: DataFrame, key: str, order: str, span: int = SPAN) -> DataFrame:
    """Packets (key, order, sample0, count, decimation: samples of the converter for each of theirs) with gap_before (samples were
    lost or came again before it) and segment, the number of the key's unbroken stretch from 0."""
    x = previous(df.withColumn("_end", F.col("sample0") + F.col("count") * F.col("decimation")).withColumnRenamed("_end", "ends"), [key], order, ["ends"], span)
    x = x.withColumn("gap_before", F.coalesce(F.col("_ends") != F.col("sample0"), F.lit(False)))
    return running(x, [key], order, F.col("gap_before").cast("int"), "segment", span=span).drop("ends", "_ends")


def unbroken_waveforms(df: DataFrame, key: str, order: str, packets_needed: int) -> DataFrame:
    """What a display can show of each segment: its first packets_needed packets, in the form of one packet or of several. A
    waveform never goes over a gap; one of fewer packets is marked short. key, segment, gap_before, sample0, first, last (of the
    order), packets, samples, window (converter samples) and short."""
    x = segments(df, key, order)
    numbered = running(x, [key, "segment"], order, F.lit(1), "_place").filter(F.col("_place") <= packets_needed)
    out = numbered.groupBy(key, "segment").agg(F.min_by("gap_before", order).alias("gap_before"), F.min("sample0").alias("sample0"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("packets"), F.sum("count").alias("samples"), F.sum(F.col("count") * F.col("decimation")).alias("window"))
    return out.withColumn("short", F.col("packets") < packets_needed)


def waveforms(df: DataFrame, window: int, points: int, center_hz: float, rate_hz: float) -> DataFrame:
    """Per channel the statistics of the samples at its first `window` places, all of which count, and at most `points` of
    them with their time and their value at radio frequency, as arrays for display."""
    start = df.groupBy("channel").agg(F.min("n").alias("_first"))
    first = df.join(start, "channel").withColumn("k", F.col("n") - F.col("_first")).filter(F.col("k") < window)
    stride = max(1, -(-window // points))
    shown = F.struct("k", (F.col("k") / rate_hz * 1e6).alias("x_us"), "i", "q", F.hypot(F.col("i").cast("double"), F.col("q").cast("double")).alias("mag"), rf_equivalent(F.col("i"), F.col("q"), F.col("n"), center_hz, rate_hz).alias("rf"))
    arrays = first.filter(F.col("k") % stride == 0).groupBy("channel").agg(F.array_sort(F.collect_list(shown)).alias("points"))
    return channel_statistics(first).join(arrays, "channel")


def preview(df: DataFrame, start: int, count: int, mask: int) -> DataFrame:
    """All channels of the mask over one span of samples from a common start; only whole spans count as complete."""
    x = df.filter((F.col("n") >= start) & (F.col("n") < start + count) & F.col("channel").isin(*[c for c in range(8) if mask >> c & 1]))
    return x.groupBy("channel").agg(F.min("n").alias("sample0"), F.count("*").alias("samples"), (F.count("*") == count).alias("complete"))


def with_version(events: DataFrame, versions: DataFrame, key: str, order: str) -> DataFrame:
    """The version in force at each event: the last one committed at or before it. Both are put in one order by key, so it
    is a window over both, not a range join."""
    both = events.withColumn("_v", F.lit(None).cast("long")).unionByName(versions.select(key, order, F.col("version").cast("long").alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("version", F.last("_v", ignorenulls=True).over(w))
    return out.filter(F.col("_v").isNull()).drop("_v")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).withColumns({"set": F.expr("capture div 8"), "channel": (F.col("capture") % 8).cast("int"), "sample0": F.col("capture") * 5})


def q_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned_phase(_sets(spark, sf_dir), "set", "channel", TONE, F.col("channel") * 10, 15.0, 0)
    return _r(out.select("set", "channel", "phase_deg", "aligned_deg", "error_deg", "delta_deg"), "phase_deg", "aligned_deg", "error_deg", "delta_deg")


def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = provenance(captures(spark, sf_dir), 245.76e6, TONE, F.col("capture") % 360)
    return _r(_r(out, "measured_deg", "coherent_deg", "residual"), "peak_hz", places=3)


def q_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = captures(spark, sf_dir).withColumn("sample0", F.col("capture") * 5)
    out = payload_metrics(df, 245.76e6, TONE, F.col("capture") % 360, 15.0)
    out = _r(_r(out, "rms", "phase_deg", "aligned_deg", "error_deg", "amplitude", "residual_rms", "residual_db", "snr_db", places=5), "peak_hz", places=0)
    return out.select("capture", "samples", "largest", "rms", "phase_deg", "aligned_deg", "error_deg", "amplitude", "residual_rms", "residual_db", "peak_hz", "snr_db", "clipped")


def q_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands to each board's table of 4 coefficients."""
    kinds = F.array(*map(F.lit, ["start", "write", "write", "write", "write", "commit", "write", "abort", "commit"]))
    df = packets(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("board_id").orderBy("e")) - 1)
    df = df.select("board_id", "e", F.get(kinds, (F.col("k") % 9).cast("int")).alias("command"), (F.col("k") % 17 == 5).alias("enabled"), F.when(F.col("k") % 63 == 18, 8).otherwise(4).alias("taps"), F.col("e").alias("id"), (F.col("e") * 7919 % 100_000 - 50_000).alias("value"))
    return run_batch(df, "board_id", "e", lambda s: CoefficientBank(4, state=s), "key int, e long, active_id long, active_sum long, error boolean, errors long").withColumnRenamed("key", "board_id")


def q_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of settings of each user but every tenth."""
    p = packets(spark, sf_dir)
    config = p.select("user_id").distinct().select("user_id", F.lit(1).cast("long").alias("generation"), F.lit(512).cast("long").alias("points"), F.lit("dual").alias("view"))
    patches = p.filter("user_id % 10 <> 0").select("user_id", "e", F.when(F.col("e") % 3 == 0, F.col("e") % 5000).alias("points"), F.when(F.col("e") % 5 == 0, F.concat(F.lit("v"), (F.col("e") % 7).cast("string"))).alias("view"))
    return patched(config, patches, "user_id", "e", ["points", "view"])


def q_raw_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(raw_spectrum(captures(spark, sf_dir), "capture", 245.76e6), "amplitude", "frequency_hz", places=3)


def q_debug_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest bin of the first 1024 samples of each channel, the first of equals."""
    s = raw_spectrum(samples(spark, sf_dir), "channel", 245.76e6, 1024)
    return s.groupBy("channel").agg(F.min(F.struct((-F.round("amplitude", 5)).alias("a"), "bin")).alias("m")).select("channel", F.col("m.bin").alias("bin"), F.round(-F.col("m.a"), 3).alias("amplitude"))


def q_two_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(two_tones(captures(spark, sf_dir), "capture", 3 / 32, 0.2), "share_a", "share_b")


def q_source_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxframe.operators.dsp import tones

    df = tones(samples(spark, sf_dir), [{"frequency_hz": 245.76e6 / 32, "phase_deg": 30 * k, "amplitude": 3000 + 1000 * k} for k in range(8)], 245.76e6)
    swapped = df.select("n", "channel", F.col("q").alias("i"), F.col("i").alias("q"))
    return _r(source_phase(swapped, "channel", 1 / 32), "phase_range_deg", "amplitude_range", "amplitude", places=3)


def q_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    points = c.select("capture", (F.col("n") + (F.col("capture") % 4) / 4).alias("at"))
    return _r(kernel_join(points, c, "capture"), "i", "q", places=3)


def q_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = waveforms(samples(spark, sf_dir), 100, 20, 60e6, 245.76e6)
    total = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c]), 3)
    return out.select("channel", F.round("rms", 6).alias("rms"), "peak", "clipped", "samples", F.size("points").alias("shown"), total("mag").alias("sum_mag"), total("rf").alias("sum_rf"))


def q_unbroken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms of four packets of each flow, of which a packet is lost every 97, and of one packet of each board."""
    p = packets(spark, sf_dir).withColumns({"k": F.expr("e div 8 + e div 776 * 3"), "count": F.lit(64).cast("long"), "decimation": F.lit(8)})
    p = p.select("flow_id", "k", (F.col("k") * 512).alias("sample0"), "count", "decimation")
    several, one = unbroken_waveforms(p, "flow_id", "k", 4), unbroken_waveforms(p, "flow_id", "k", 1)
    return several.withColumn("form", F.lit("several")).union(one.withColumn("form", F.lit("one")))


def q_preview_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(samples(spark, sf_dir), 8, 64, 0b11110011)


def q_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient table in force at each packet: a board commits a new one now and then."""
    p = packets(spark, sf_dir).select("board_id", "e")
    commits = p.filter("e % 50 = 3").select("board_id", "e", F.expr("e div 50").alias("version"))
    return with_version(p, commits, "board_id", "e").select("e", "version")


QUERIES = {
    "payload_metrics": q_payload, "coefficient_bank": q_bank, "config_patches": q_patches, "aligned_phase": q_aligned, "phase_provenance": q_provenance, "raw_spectrum": q_raw_spectrum, "debug_fft_peak": q_debug_peak, "two_tone_fit": q_two_tones, "source_phase": q_source_phase, "kernel_range_join": q_kernel,
    "waveform_build": q_waveforms, "waveform_segments": q_unbroken, "preview_slice": q_preview_slice, "version_in_force": q_versions,
}


def _share(c: float) -> str:
    t = f"2 * pi() * ((n * {c!r}::DOUBLE) % 1.0)"
    return f"""SELECT capture, CASE WHEN vv > 0 AND abs(xx * yy - xy * xy) > 1e-9 THEN ((xv * yy - yv * xy) * xv + (yv * xx - xv * xy) * yv) / (xx * yy - xy * xy) / vv ELSE 0.0 END AS share
        FROM (SELECT capture, sum(cos({t}) ** 2) AS xx, sum(sin({t}) ** 2) AS yy, sum(cos({t}) * sin({t})) AS xy, sum(cos({t}) * i) AS xv, sum(sin({t}) * i) AS yv, sum(i::DOUBLE * i) AS vv FROM captures GROUP BY capture)"""


_SINC = "CASE WHEN abs(d) < 1e-12 THEN 1.0 ELSE sin(pi() * d) / (pi() * d) * (sin(pi() * d / 12) / (pi() * d / 12)) END"
_SOURCE = """iq AS (SELECT n, channel, i::DOUBLE AS i, q::DOUBLE AS q FROM tones), a AS (SELECT n, channel, sqrt(i * i + q * q) AS size, radians(180 - ((180 - w) - 360 * floor((180 - w) / 360))) AS turn FROM (SELECT *, degrees(atan2(i, q)) - 360 * ((n * 0.03125::DOUBLE) % 1.0) AS w FROM iq)),
    d AS (SELECT *, turn - lag(turn) OVER (PARTITION BY channel ORDER BY n) AS step FROM a),
    turns AS (SELECT *, turn + sum(CASE WHEN step IS NULL OR abs(step) < pi() THEN 0.0 WHEN step > 0 THEN -2 * pi() ELSE 2 * pi() END) OVER (PARTITION BY channel ORDER BY n) AS unwrapped FROM d)"""
_RAW = """f AS (SELECT capture, k, sum(i * cos(2 * pi() * (n * k % 32) / 32) + q * sin(2 * pi() * (n * k % 32) / 32)) / 32 AS re, sum(q * cos(2 * pi() * (n * k % 32) / 32) - i * sin(2 * pi() * (n * k % 32) / 32)) / 32 AS im FROM captures, (SELECT unnest(range(32)) AS k) GROUP BY capture, k)"""
_DEBUG = """s AS (SELECT channel, i, q, n - first AS n, least(1024, total) AS m FROM (SELECT *, min(n) OVER (PARTITION BY channel) AS first, count(*) OVER (PARTITION BY channel) AS total FROM samples) WHERE n < first + 1024),
    f AS (SELECT channel, k, sum(i * cos(2 * pi() * (n * k % m) / m) + q * sin(2 * pi() * (n * k % m) / m)) / any_value(m) AS re, sum(q * cos(2 * pi() * (n * k % m) / m) - i * sin(2 * pi() * (n * k % m) / m)) / any_value(m) AS im FROM s, (SELECT unnest(range(1024)) AS k) WHERE k < m GROUP BY channel, k),
    a AS (SELECT channel, k, round(sqrt(re * re + im * im), 5) AS amplitude FROM f)"""

_BANK = """ev AS (SELECT *, ['start', 'write', 'write', 'write', 'write', 'commit', 'write', 'abort', 'commit'][k % 9 + 1] AS command, k % 17 = 5 AS enabled, CASE WHEN k % 63 = 18 THEN 8 ELSE 4 END AS taps, e * 7919 % 100000 - 50000 AS value
        FROM (SELECT board_id, e, row_number() OVER (PARTITION BY board_id ORDER BY e) - 1 AS k FROM packets)),
    r AS (
        SELECT board_id, -1::BIGINT AS k, NULL::BIGINT AS e, false AS loading, 0 AS loaded, 0::BIGINT AS total, NULL::BIGINT AS id, NULL::BIGINT AS active_id, NULL::BIGINT AS active_sum, false AS error, 0::BIGINT AS errors FROM ev WHERE k = 0
        UNION ALL
        SELECT board_id, k, e, CASE WHEN refused THEN loading WHEN command = 'start' THEN true WHEN command IN ('abort', 'commit') THEN false ELSE loading END, CASE WHEN refused THEN loaded WHEN command IN ('start', 'abort', 'commit') THEN 0 ELSE loaded + 1 END,
            CASE WHEN refused THEN total WHEN command = 'start' THEN 0 WHEN command = 'write' THEN ((total + value) % 4294967296 + 4294967296) % 4294967296 ELSE total END, CASE WHEN command = 'start' AND NOT refused THEN e ELSE id END,
            CASE WHEN command = 'commit' AND NOT refused THEN id ELSE active_id END, CASE WHEN command = 'commit' AND NOT refused THEN total ELSE active_sum END, CASE WHEN refused THEN true WHEN command IN ('start', 'commit') THEN false ELSE error END, errors + refused::INTEGER
        FROM (SELECT ev.board_id, ev.k, ev.e, command, value, loading, loaded, total, id, active_id, active_sum, error, errors,
            CASE command WHEN 'start' THEN enabled OR taps <> 4 WHEN 'write' THEN NOT loading WHEN 'commit' THEN enabled OR loaded < 4 ELSE false END AS refused FROM r JOIN ev ON ev.board_id = r.board_id AND ev.k = r.k + 1)
    )"""
_PAYLOAD = _PROJ + ", " + spectrum_sql() + f""", bs AS (SELECT capture, count(*) AS samples, max(greatest(abs(i), abs(q))) AS largest, sqrt(avg((i * i + q * q)::DOUBLE)) AS rms FROM captures GROUP BY capture),
    tp AS (SELECT capture, arg_min(bin, (-round(dbfs, 6), bin)) AS peak FROM z GROUP BY capture),
    ns AS (SELECT capture, max(frequency_hz) FILTER (bin = peak) AS hz, max(dbfs) FILTER (bin = peak - 1) AS a, max(dbfs) FILTER (bin = peak) AS b, max(dbfs) FILTER (bin = peak + 1) AS c, median(dbfs) FILTER (abs(bin - peak) > 2) AS noise FROM z JOIN tp USING (capture) GROUP BY capture),
    al AS (SELECT *, {_wrap(f'phase_deg - 360 * ((capture * 5 * {TONE}) % 1.0)')} AS aligned FROM pr)"""

SQL = {
    "payload_metrics": _over("captures", _PAYLOAD, f"SELECT capture, samples, largest, round(bs.rms, 5) AS rms, round(phase_deg, 5) + 0.0 AS phase_deg, round(aligned, 5) + 0.0 AS aligned_deg, round({_wrap('aligned - capture % 360 - 15')}, 5) + 0.0 AS error_deg, round(amplitude, 5) AS amplitude, round(al.rms, 5) AS residual_rms, round(20 * log10(greatest(residual, 1e-12)), 5) + 0.0 AS residual_db, round(hz + CASE WHEN a IS NULL OR c IS NULL OR a - 2 * b + c = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, (a - c) / 2 / (a - 2 * b + c))) END * 960000.0::DOUBLE, 0) + 0.0 AS peak_hz, round(b - noise, 5) AS snr_db, largest >= 32760 AS clipped FROM al JOIN bs USING (capture) JOIN ns USING (capture)"),
    "coefficient_bank": stepped("packets", _BANK, "SELECT board_id, e, active_id, active_sum, error, errors FROM r WHERE k >= 0"),
    "config_patches": sql("packets", "SELECT u.user_id, 1 + coalesce(n, 0) AS generation, coalesce(p.points, 512) AS points, coalesce(p.view, 'dual') AS view, coalesce(n, 0) > 0 AS cleared FROM (SELECT DISTINCT user_id FROM packets) u LEFT JOIN (SELECT user_id, count(*) AS n, arg_max(e % 5000, e) FILTER (e % 3 = 0) AS points, arg_max('v' || e % 7, e) FILTER (e % 5 = 0) AS view FROM packets WHERE user_id % 10 <> 0 GROUP BY user_id) p USING (user_id)"),
    "phase_provenance": _over("captures", _PROJ + ", " + spectrum_sql() + ", top AS (SELECT capture, arg_min(frequency_hz, (-round(dbfs, 6), bin)) AS peak_hz FROM z GROUP BY capture)", f"SELECT capture, capture % 360 AS configured_deg, round(phase_deg, 6) + 0.0 AS measured_deg, round({_wrap(f'phase_deg - 360 * ((capture * 5 * {TONE}) % 1.0)')}, 6) + 0.0 AS coherent_deg, peak_hz, round(residual, 6) AS residual FROM pr JOIN top USING (capture)"),
    "raw_spectrum": _over("captures", _RAW, "SELECT capture, k::INTEGER AS bin, least(k, 32 - k)::INTEGER AS display_bin, (CASE WHEN k < 16 THEN k ELSE k - 32 END) * 7680000.0::DOUBLE AS frequency_hz, round(sqrt(re * re + im * im), 3) AS amplitude FROM f"),
    "debug_fft_peak": _over("samples", _DEBUG, "SELECT channel, arg_min(k, (-amplitude, k))::INTEGER AS bin, round(max(amplitude), 3) AS amplitude FROM a GROUP BY channel"),
    "source_phase": _over("samples", tones_sql("245.76e6 / 32", "30 * c", "3000 + 1000 * c", "0") + ", " + _SOURCE, "SELECT channel, round(degrees(max(unwrapped) - min(unwrapped)), 3) + 0.0 AS phase_range_deg, round(max(size) - min(size), 3) + 0.0 AS amplitude_range, round(avg(size), 3) AS amplitude FROM turns GROUP BY channel"),
    "aligned_phase": _over("captures", _PROJ, f"""SELECT "set", channel, round(phase_deg, 6) + 0.0 AS phase_deg, round(aligned, 6) + 0.0 AS aligned_deg, round({_wrap('aligned - channel * 10 - 15')}, 6) + 0.0 AS error_deg, round({_wrap('aligned - ref')}, 6) + 0.0 AS delta_deg
        FROM (SELECT *, max(aligned) FILTER (channel = 0) OVER (PARTITION BY "set") AS ref FROM (SELECT capture // 8 AS "set", (capture % 8)::INTEGER AS channel, phase_deg, {_wrap(f'phase_deg - 360 * ((capture * 5 * {TONE}) % 1.0)')} AS aligned FROM pr))"""),
    "two_tone_fit": sql("captures", f"SELECT capture, round(a.share, 6) + 0.0 AS share_a, round(b.share, 6) + 0.0 AS share_b, (CASE WHEN a.share >= b.share THEN 0 ELSE 1 END)::INTEGER AS better FROM ({_share(3 / 32)}) a JOIN ({_share(0.2)}) b USING (capture)"),
    "kernel_range_join": sql("captures", f"""SELECT capture, "at", round(sum(k * i) / sum(k), 3) + 0.0 AS i, round(sum(k * q) / sum(k), 3) + 0.0 AS q, count(*) AS taps FROM (SELECT *, {_SINC} AS k FROM (SELECT p.capture, p."at", g.i, g.q, p."at" - g.n AS d FROM (SELECT capture, n + capture % 4 / 4 AS "at" FROM captures) p JOIN captures g ON g.capture = p.capture AND abs(p."at" - g.n) < 12)) GROUP BY ALL"""),
    "waveform_build": sql("samples", """SELECT channel, round(sqrt(avg(i::BIGINT * i + q::BIGINT * q)), 6) AS rms, max(greatest(least(abs(i), 32767), least(abs(q), 32767))) AS peak, count(*) FILTER (greatest(abs(i), abs(q)) >= 32760) AS clipped, count(*) AS samples, (count(*) FILTER (k % 5 = 0))::INTEGER AS shown,
        round(sum(sqrt(i::DOUBLE * i + q::DOUBLE * q)) FILTER (k % 5 = 0), 3) AS sum_mag, round(sum(i * cos(t) - q * sin(t)) FILTER (k % 5 = 0), 3) AS sum_rf FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n) - 1 AS k, ((n * (60e6 / 245.76e6)) % 1.0) * 2 * pi() AS t FROM samples) WHERE k < 100 GROUP BY channel"""),
    "waveform_segments": sql("packets", """SELECT flow_id, segment::BIGINT AS segment, bool_or(gap AND place = 1) AS gap_before, min(k) * 512 AS sample0, min(k) AS first, max(k) AS last, count(*) AS packets, count(*) * 64 AS samples, count(*) * 512 AS "window", count(*) < needed AS short, CASE needed WHEN 1 THEN 'one' ELSE 'several' END AS form
        FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, segment ORDER BY k) AS place FROM (SELECT *, sum(gap::INTEGER) OVER (PARTITION BY flow_id ORDER BY k) AS segment FROM (SELECT flow_id, k, coalesce(k - lag(k) OVER (PARTITION BY flow_id ORDER BY k) <> 1, false) AS gap FROM (SELECT flow_id, e // 8 + e // 776 * 3 AS k FROM packets)))),
        (SELECT unnest([1, 4]) AS needed) WHERE place <= needed GROUP BY flow_id, segment, needed"""),
    "preview_slice": sql("samples", "SELECT channel, min(n) AS sample0, count(*) AS samples, count(*) = 64 AS complete FROM samples WHERE n >= 8 AND n < 72 AND (243 >> channel) & 1 = 1 GROUP BY channel"),
    "version_in_force": sql("packets", "SELECT e, max(CASE WHEN e % 50 = 3 THEN e // 50 END) OVER (PARTITION BY board_id ORDER BY e) AS version FROM packets"),
}
