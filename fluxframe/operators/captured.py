"""Queries over capture files: packets written as frames, and read back in byte ranges with filters pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.operators.codec import encode_frames, parse_frame
from fluxframe.plans.views import packets, sql
from fluxframe.sources.captures import frames, scratch, write_captures


def q_capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet as a frame in a capture file; read back, those of 20 of the 24 ports, with their times and payloads."""
    p = packets(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "src_port", "dst_port", F.unhex(F.lpad(F.hex("e"), 16, "0")).alias("payload"))
    path = scratch(spark, "captures")
    write_captures(encode_frames(p), path)
    got = frames(spark, path, split_bytes=1 << 18).filter((F.col("dst_port") >= 4302) & (F.col("dst_port") < 4322))
    out = got.select("ts", "dst_port", parse_frame(F.col("frame")).alias("p")).filter("p.error IS NULL")
    return out.select(F.conv(F.hex("p.payload"), 16, 10).cast("long").alias("e"), F.unix_micros("ts").alias("us"), "dst_port", "p.src_port")


QUERIES = {"capture_files": q_capture_files}

SQL = {"capture_files": sql("packets", "SELECT e, epoch_us(ts)::BIGINT AS us, dst_port, src_port FROM packets WHERE dst_port >= 4302 AND dst_port < 4322")}
