"""Blocks of an order against one window a key, and how the rows of one key are dealt."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxframe.operators import flows, spectrum
from fluxframe.operators.ordered import previous, running


@pytest.fixture(scope="module")
def rows(spark):
    """Keys (one null) of whole numbers with holes, some below zero."""
    return spark.range(-700, 900).filter("id % 7 <> 2 and (id < 100 or id > 400)").select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), F.col("id").alias("n"), (F.col("id") * 31 % 17).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("maybe"))


@pytest.mark.parametrize("span", [1, 16, 1 << 16])
def test_against_windows(rows, span):
    w = Window.partitionBy("key").orderBy("n")
    got = previous(rows, ["key"], "n", ["v", "maybe"], span)
    assert sorted(map(str, got.select("key", "n", "_v", "_maybe").collect())) == sorted(map(str, rows.select("key", "n", F.lag("v").over(w).alias("_v"), F.lag("maybe").over(w).alias("_maybe")).collect()))
    got = running(rows, ["key"], "n", F.col("v"), "up_to", "all", span)
    assert got.columns == [*rows.columns, "up_to", "all"]
    assert sorted(map(str, got.select("key", "n", "up_to", "all").collect())) == sorted(map(str, rows.select("key", "n", F.sum("v").over(w).alias("up_to"), F.sum("v").over(Window.partitionBy("key")).alias("all")).collect()))


@pytest.mark.parametrize("of", ["previous", "running", "continuity", "unwrapped"])
def test_one_key_is_many_tasks(spark, of):
    """All rows of one flow: every task gets its share, and no exchange is by the flow alone but that of a row a block."""
    n, span = 200_000, 1 << 11
    df = spark.range(n).select(F.lit(3).alias("flow_id"), F.col("id").alias("seq_no"), F.col("id").alias("frame_id"), (F.col("id") * 256).alias("sample0"), F.lit(64).alias("time_count"), (F.col("id") * 2.0 % math.pi).alias("phase"))
    make = {
        "previous": lambda: previous(df, ["flow_id"], "seq_no", ["frame_id"], span), "running": lambda: running(df, ["flow_id"], "seq_no", F.lit(1), "k", span=span),
        "continuity": lambda: flows.continuity(df, 1, F.lit(200), span=span), "unwrapped": lambda: spectrum.unwrapped(df, "flow_id", "seq_no", "phase", span),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = make[of]()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < 2 * n / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    if of == "continuity":
        assert out.agg(F.sum("seq_gap"), F.sum("sample0_gap"), F.sum("app_drops")).first() == (0, 0, 0)


def test_gaps_at_block_borders(spark):
    """A loss that falls on a border of blocks, one of whole blocks, a repeat and a step back."""
    numbers = [*range(0, 64), *range(70, 128), *range(600, 640), 640, 640, 641]
    df = spark.createDataFrame([(1, s, s, s * 256, 64, 100, k) for k, s in enumerate(numbers)], "flow_id int, seq_no long, frame_id long, sample0 long, time_count int, udp_payload_len int, k int")
    for span in (1, 8, 64, 1 << 16):
        r = flows.flow_statistics(flows.continuity(df, 1, F.lit(200), span=span)).first()
        assert (r.packets, r.seq_gaps, r.app_drops, r.last_seq_no) == (len(numbers), 3, 6 + 472 + 1, 641)


@pytest.mark.parametrize("span", [4, 1 << 16])
def test_unwrap_against_numpy(spark, span):
    """Two keys, one of them null."""
    rng = np.random.default_rng(3)
    phase = (np.cumsum(rng.normal(0.8, 1.2, 500)) + math.pi) % (2 * math.pi) - math.pi
    df = spark.createDataFrame([(key, k, float(p)) for key in (0, None) for k, p in enumerate(phase)], "key int, n long, phase double")
    out = spectrum.unwrapped(df, "key", "n", "phase", span)
    assert out.columns == [*df.columns, "unwrapped"]
    rows = out.orderBy("key", "n").collect()
    for part in (rows[:500], rows[500:]):
        assert np.allclose([r.unwrapped for r in part], np.unwrap(phase), atol=1e-9)
