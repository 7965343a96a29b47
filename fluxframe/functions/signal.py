"""Expressions of the signal domain: phases, rates, bins, amplitudes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ADC_HZ = 245_760_000
#: Bandwidth in MHz -> decimation.
DECIMATION = {200: 1, 100: 2, 20: 8}


def wrap_degrees(x: Column) -> Column:
    """x in (-180, 180]."""
    return F.lit(180) - F.pmod(F.lit(180) - x, F.lit(360))


def power_db(mean_power: Column) -> Column:
    """10 log10 with a floor of 1, so that no power gives 0 dB."""
    return 10 * F.log10(F.greatest(mean_power, F.lit(1.0)))


def dbfs(amplitude: Column, full_scale: Column | float) -> Column:
    return 20 * F.log10(F.greatest(amplitude / full_scale, F.lit(1e-12)))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def to_db(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-24)))


def samples_per_cycle(rate_hz: Column, tone_hz: Column) -> Column:
    return F.when(F.abs(tone_hz) < 1, F.lit(math.inf)).otherwise(rate_hz / F.abs(tone_hz))


def rf_equivalent(i: Column, q: Column, sample: Column, center_hz: Column | float, rate_hz: float, sign: int = 1) -> Column:
    """i cos(t) - sign q sin(t) at t = 2 pi center sample / rate, with whole cycles taken off first."""
    cycles = F.pmod(sample * (center_hz / F.lit(float(rate_hz))), F.lit(1.0))
    t = cycles * (2 * math.pi)
    return i * F.cos(t) - sign * q * F.sin(t)


def signed_bin(k: Column, n: int) -> Column:
    """Bin k of n as a number from -n / 2."""
    return F.pmod(k + n // 2, F.lit(n)) - n // 2


def bin_rf_hz(k: Column, center_hz: float, rate_hz: float, n: int, orientation: int = -1) -> Column:
    """Frequency of a bin; orientation is -1 for received spectra and 1 for the configuration's geometry."""
    return F.lit(float(center_hz)) + orientation * signed_bin(k, n) * F.lit(rate_hz / n)


def nearest_bin(rf_hz: Column, center_hz: float, rate_hz: float, n: int, orientation: int = -1) -> Column:
    """The bin next to a frequency, halves to even."""
    return F.pmod(F.rint(orientation * (rf_hz - center_hz) / (rate_hz / n)).cast("long"), F.lit(n))


def nearest_bin_half_up(rf_hz: Column, center_hz: float, rate_hz: float, n: int, orientation: int = -1) -> Column:
    return F.pmod(F.floor(orientation * (rf_hz - center_hz) / (rate_hz / n) + 0.5), F.lit(n))


def phase_word(frequency_hz: Column, rate_hz: float) -> Column:
    """The step of a 32-bit phase accumulator."""
    return F.pmod(F.rint(frequency_hz / F.lit(float(rate_hz)) * F.lit(float(1 << 32))).cast("long"), F.lit(1 << 32))


def phase0_word(degrees: Column) -> Column:
    return F.pmod(F.rint(degrees / 360 * F.lit(float(1 << 32))).cast("long"), F.lit(1 << 32))


def amplitude_code(percent: Column) -> Column:
    """0 to 100 percent as 0 to 32767, halves to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)) * 32767 / 100).cast("int")


def bandwidth_mhz(text: Column) -> Column:
    """"100MHz", "100 mhz" or "100" as 100; null for any bandwidth but 20, 100 and 200."""
    n = F.rint(F.regexp_extract(F.lower(F.trim(text)), r"^([0-9]{1,6})\s*(mhz)?$", 1).try_cast("double")).cast("int")
    return F.when(n.isin(*DECIMATION), n)


def decimation(mhz: Column) -> Column:
    out = F.lit(None).cast("int")
    for b, d in DECIMATION.items():
        out = F.when(mhz == b, F.lit(d)).otherwise(out)
    return out


def sample_rate_hz(mhz: Column) -> Column:
    return F.lit(ADC_HZ) / decimation(mhz)


def expected_sample_delta(time_count: Column, mhz: Column) -> Column:
    return time_count * 4 * decimation(mhz)


def infer_bandwidth(delta: Column, time_count: Column) -> Column:
    """The bandwidth whose packets of time_count beats are delta samples apart, else null."""
    out = F.lit(None).cast("int")
    for b, d in DECIMATION.items():
        out = F.when((time_count > 0) & (delta == time_count * 4 * d), F.lit(b)).otherwise(out)
    return out


def capture_count(rate_hz: Column, window_us: Column, oversample: Column | float = 2.5, least: int = 512, most: int = 1024) -> Column:
    """Samples to capture for a window: its samples times the oversampling (1 at least), `least` at least, rounded up to a power
    of two, and `most` at most. Rates and windows that are not positive raise."""
    over = F.greatest(F.lit(1.0), oversample if isinstance(oversample, Column) else F.lit(float(oversample)))
    n = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(2), F.lit(least), F.ceil(rate_hz * window_us * 1e-6 * over))))).cast("long")
    return F.when((rate_hz > 0) & (window_us > 0), F.least(F.lit(most), n)).otherwise(F.raise_error(F.lit("a positive rate and window are needed")).cast("long"))


def payload_rate(mhz: Column, mode: Column, ninput: int = 8, iq_bits: int = 16, payload_bytes: int = 8192) -> Column:
    """What a profile will send: payload_mbps, packets a second, wire_mbps (with headers and gaps of a frame), and whether it is
    allowed. The mode monitor sends all samples and one spectrum in 64."""
    streams = F.when(mode.isin("time_only", "spec_only"), 1.0).when(mode == "time_spec", 2.0).when(mode == "monitor", 1 + 1 / 64).otherwise(0.0)
    bits = sample_rate_hz(mhz) * float(ninput * 2 * iq_bits) * streams
    frame = payload_bytes + 128 + 42 + 24
    return F.struct((bits / 1e6).alias("payload_mbps"), (bits / 8 / payload_bytes).alias("packets_per_sec"), (bits / 1e6 * frame / payload_bytes).alias("wire_mbps"), (~((mhz == 200) & (mode == "time_spec"))).alias("allowed"))


def next_power_of_two(n: Column, least: int, most: int) -> Column:
    """The power of two from n on, within limits that are powers of two."""
    clamped = F.greatest(F.lit(least), F.least(F.lit(most), n))
    return F.pow(F.lit(2), F.ceil(F.log2(clamped))).cast("long")
