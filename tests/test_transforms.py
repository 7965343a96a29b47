"""The channeliser by stages, banded interpolation, and waveforms broken at gaps."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fluxframe import catalog
from fluxframe.operators import analysis, spectrum


@pytest.mark.parametrize("n, stages", [(4, 1), (16, 2), (4096, 6)])
def test_radix4(n, stages):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(3, n)) + 1j * rng.normal(size=(3, n))
    got, over = spectrum.radix4(x, [0] * stages)
    assert np.allclose(got, np.fft.fft(x)) and not over.any()
    got, _ = spectrum.radix4(x, [2] * stages)
    assert np.allclose(got, np.fft.fft(x) / n)


def test_overflow_depends_on_the_schedule(spark):
    """A full-scale constant grows by four in each stage that doesn't divide: late shifts overflow on the way, even ones don't."""
    df = spark.range(256).selectExpr("cast(0 as int) AS channel", "cast(id div 256 as long) AS frame", "cast(id as int) AS phase", "30000 AS i", "0 AS q")
    over = {s: spectrum.channelise(df, 256, s).agg({"overflows": "max"}).first()[0] for s in (0b10101010, 0b11110000)}
    assert over[0b10101010] == 0 and over[0b11110000] > 0
    total = spectrum.channelise(df, 256, 0b11110101).filter("bin = 0").first()
    assert total.re == pytest.approx(30000 * 256 / 2**8)
    with pytest.raises(ValueError):
        spectrum.channelise(df, 8, 1)
    with pytest.raises(ValueError):
        spectrum.channelise(df, 256, 256)


def test_overflows_are_of_stored_values():
    """What a turn makes of a value that fits is no overflow, and -32768 fits; sums that outgrow 16 bits still count."""
    x = np.zeros((1, 256), complex)
    x[0, 32::64] = 32767 * np.array([1 + 1j, -1 + 1j, -1 - 1j, 1 - 1j])  # four that add up in one sum, which is then turned by 45 degrees
    assert spectrum.radix4(x, [2] * 4)[1][0] == 0
    assert spectrum.radix4(np.full((1, 256), -32768 * (1 + 1j)), [2] * 4)[1][0] == 0
    assert spectrum.radix4(np.full((1, 256), 32768 + 0j), [2] * 4)[1][0] > 0
    assert spectrum.radix4(np.full((1, 256), 10000 + 0j), [0, 2, 2, 2])[1][0] > 0
    assert spectrum.radix4(x, [0, 2, 2, 2])[1][0] > 0


def test_channelise_4096_gives_ties_and_overflows_of_its_sql(spark, tmp_path):
    """The energy of about half of the frames lies half between two values shown; some frames have values that a turn takes over 32767."""
    frames, ties, rng = 12, 0, np.random.default_rng(4096)
    e = np.arange(frames * 4096 * 8)
    v = rng.integers(0, 50000, len(e))
    i, q = (lambda v, e: (v * 7919 + e * 104729) % 65536 - 32768), (lambda v, e: (v * 15485863 + e * 1299709) % 65536 - 32768)
    power, any_v = i(v, e) ** 2 + q(v, e) ** 2, np.arange(60000)
    for frame in range(frames):
        for channel in range(8):
            mine = slice(frame * 32768 + channel, (frame + 1) * 32768, 8)
            last = (frame + 1) * 32768 - 8 + channel
            total = power[mine].sum() - power[last] + i(any_v, last) ** 2 + q(any_v, last) ** 2
            tie = np.flatnonzero(total % 1000 == 500)[:1]
            v[last], ties = tie[0] if len(tie) else v[last], ties + len(tie)
    pd.DataFrame({"event_id": e, "value": v / 100}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalog.oracle_sql()["channelise_4096"]).df()
    got = catalog.queries()["channelise_4096"](spark, str(tmp_path)).toPandas()[list(want.columns)]
    by = ["channel", "frame"]
    assert len(want) == frames * 8 and ties > frames * 3
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True), check_exact=True, check_dtype=False)


def dense(n, z, at, spacing=1.0, radius=12):
    """The rule place by place."""
    out = []
    for x in at:
        d = (x - n) / spacing
        near = z[np.abs(d).argmin()]
        if len(n) < 4 or np.abs(d).min() < 1e-9:
            out.append(near)
            continue
        w = np.where(np.abs(d) < radius, np.sinc(d) * np.sinc(d / radius), 0)
        out.append((w * z).sum() / w.sum() if abs(w.sum()) > 1e-9 else near)
    return np.array(out)


@pytest.mark.parametrize("case", ["even", "holes", "few", "decimated", "long"])
def test_banded(case):
    rng = np.random.default_rng(7)
    n = {"even": np.arange(300.0), "holes": np.sort(rng.choice(900, 200, replace=False)).astype(float), "few": np.array([1.0, 4.0, 9.0]), "decimated": np.arange(200.0) * 8, "long": np.arange(5000.0)}[case]
    z = rng.normal(size=len(n)) + 1j * rng.normal(size=len(n))
    at = np.linspace(n[0], n[-1], 700)
    spacing = 8.0 if case == "decimated" else 1.0
    assert np.allclose(spectrum.banded(n, z, at, spacing), dense(n, z, at, spacing))
    assert np.array_equal(spectrum.banded(n, z, n, spacing), z)  # a sample at the place is the value


def test_grid_is_clamped_and_large_grids_stay_small(spark):
    df = spark.range(16384).selectExpr("1 AS capture", "id AS n", "cast(1000 * cos(id / 9.0) as int) AS i", "cast(1000 * sin(id / 9.0) as int) AS q")
    assert spectrum.resample(df, "capture", 1 << 20).count() == 16384
    assert spectrum.resample(df.filter("n < 100"), "capture", 3).count() == 64


def test_kernel_join_hits_and_falls_back(spark):
    grid = spark.createDataFrame([(1, k, 10 * k, -k) for k in range(40)], "key int, n long, i int, q int")
    points = spark.createDataFrame([(1, 7.0), (1, 7.0 + 1e-12), (1, 7.5)], "key int, at double")
    got = {r["at"]: r for r in analysis.kernel_join(points, grid, "key").collect()}
    assert (got[7.0].i, got[7.0].q) == (70.0, -7.0) == (got[7.0 + 1e-12].i, got[7.0 + 1e-12].q)
    assert got[7.5].i == pytest.approx(75, abs=1.5)


def test_waveforms_stop_at_gaps(spark):
    """Losses, a repeat and a step back break a waveform; a change of decimation alone doesn't."""
    rows, at = [], 0
    for k in range(30):
        if k in (5, 17):
            at += 256  # lost
        if k == 22:
            at -= 512  # a step back
        decimation = 4 if k < 10 else 8
        rows.append((1, k, at, 64, decimation))
        at += 64 * decimation
    df = spark.createDataFrame(rows, "flow int, k long, sample0 long, count long, decimation int")
    got = {r.k: (r.gap_before, r.segment) for r in analysis.segments(df, "flow", "k", 4).collect()}
    assert got == {k: (k in (5, 17, 22), sum(k >= x for x in (5, 17, 22))) for k in range(30)}
    shown = [(r.segment, r.gap_before, r.first, r.last, r.packets, r.samples, r.window, r.short) for r in analysis.unbroken_waveforms(df, "flow", "k", 8).orderBy("segment").collect()]
    assert shown == [(0, False, 0, 4, 5, 320, 1280, True), (1, True, 5, 12, 8, 512, 5 * 256 + 3 * 512, False), (2, True, 17, 21, 5, 320, 2560, True), (3, True, 22, 29, 8, 512, 4096, False)]
