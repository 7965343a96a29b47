"""Deterministic views of the driver's tables that exercise the operators, in Spark and, for comparison, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: column -> expression over events, common to both engines but for the division.
_PACKET = {
    "e": "event_id",
    "seq_no": "event_id + event_id {div} 97 * 8",
    "frame_id": "event_id + event_id {div} 97 * 8",
    "sample0": "(event_id + event_id {div} 97 * 8) * 512",
    "flow_id": "cast(event_id % 8 as int)",
    "src_port": "cast(4000 + event_id % 3 as int)",
    "dst_port": "cast(4300 + event_id % 24 as int)",
    "board_id": "cast(user_id % 4 as int)",
    "user_id": "user_id",
    "block_index": "cast(event_id % 16 as int)",
    "block_count": "cast(16 as int)",
    "frame_group": "event_id {div} 16",
    "chan0": "event_id % 16 * 256 + case when event_id % 19 = 0 then 1 else 0 end",
    "chan_count": "cast(case when event_id % 23 = 0 then 128 else 256 end as int)",
    "magic": "cast(case when event_id % 83 = 0 then 1 else 1412772144 end as bigint)",
    "version": "cast(case when event_id % 101 = 0 then 9 when event_id % 2 = 0 then 2 else 3 end as int)",
    "header_bytes": "cast(case when event_id % 103 = 0 then 64 else 128 end as int)",
    "stream_type": "cast(case when event_id % 11 = 1 then 2 when event_id % 3 = 0 then 0 else 1 end as int)",
    "ninput": "cast(case when event_id % 107 = 0 then 4 else 8 end as int)",
    "payload_format": "cast(case when event_id % 109 = 0 then 1 else 0 end as int)",
    "payload_bytes": "cast(case when event_id % 113 = 0 then 4096 else 8192 end as bigint)",
    "udp_payload_len": "cast(case when event_id % 127 = 0 then 8000 else 8320 end as int)",
    "time_count": "cast(case when event_id % 3 = 0 then 1 when event_id % 131 = 0 then 128 else 64 end as int)",
    "product_id": "cast(case when event_id % 57 = 0 then 1 else 61697 end as int)",
    "nchan": "cast(4096 as int)",
    "pfb_taps": "cast(event_id % 2 * 4 as int)",
    "spec_status_flags": "cast(case when event_id % 2 = 0 then 256 else 1024 end as bigint)",
    "value": "value",
    "ts": "ts",
}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet an event, with damaged headers here and there, and a packet of each flow lost every 97: numbers leap there."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{x.format(div='div')} AS {c}" for c, x in _PACKET.items()])


PACKETS = "packets AS (SELECT " + ", ".join(f"{x.format(div='//')} AS {c}" for c, x in _PACKET.items()) + " FROM events)"

_V = "cast(round(value * 100) as bigint)"
_IQ = {
    "n": "event_id {div} 8",
    "channel": "cast(event_id % 8 as int)",
    "i": f"cast(({_V} * 7919 + event_id * 104729) % 65536 - 32768 as int)",
    "q": f"cast(({_V} * 15485863 + event_id * 1299709) % 65536 - 32768 as int)",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex integer samples of eight channels: n, channel, i, q."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{x.format(div='div')} AS {c}" for c, x in _IQ.items()])


SAMPLES = "samples AS (SELECT " + ", ".join(f"{x.format(div='//')} AS {c}" for c, x in _IQ.items()) + " FROM events)"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples of captures from the embeddings: capture, n, i, q, 32 samples a capture."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    v = F.round(F.col("x").cast("double") * 32767).cast("long")
    pair = e.select("vec_id", F.expr("p div 2").alias("n"), (F.col("p") % 2).alias("part"), v.alias("v"))
    return pair.groupBy(F.col("vec_id").alias("capture"), "n").agg(F.max(F.when(F.col("part") == 0, F.col("v"))).alias("i"), F.max(F.when(F.col("part") == 1, F.col("v"))).alias("q"))


CAPTURES = """captures AS (
    SELECT vec_id AS capture, k AS n, round(embedding[2 * k + 1]::DOUBLE * 32767)::BIGINT AS i, round(embedding[2 * k + 2]::DOUBLE * 32767)::BIGINT AS q
    FROM embeddings, (SELECT unnest(range(32)) AS k)
)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of counters by day and board: running sums of orders modulo 2 ** 32."""
    from pyspark.sql import Window

    day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 2).cast("int").alias("board_id"))
    day = day.agg(F.sum(F.round(F.col("o_totalprice") * 1000).cast("long")).alias("x"), F.count("*").alias("packets"))
    w = Window.partitionBy("board_id").orderBy("day")
    return day.select("day", "board_id", F.pmod(F.sum("x").over(w), F.lit(1 << 32)).alias("value"), F.sum("packets").over(w).alias("packets"))


COUNTERS = """counters AS (
    SELECT day, board_id, (sum(x) OVER w % 4294967296)::BIGINT AS value, (sum(packets) OVER w)::BIGINT AS packets
    FROM (SELECT o_orderdate::DATE AS day, (o_custkey % 2)::INTEGER AS board_id, sum(round(o_totalprice * 1000)::BIGINT)::BIGINT AS x, count(*) AS packets FROM orders GROUP BY ALL)
    WINDOW w AS (PARTITION BY board_id ORDER BY day)
)"""


def stepped(views: str, tables: str, query: str) -> str:
    """DuckDB SQL of a state machine: more tables, one of them recursive over a key's events."""
    return sql(views, "").strip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + tables + " " + query


#: The table of CRC-32 by its polynomial, as one list; crc_sql() folds a list of bytes with it.
CRC_TABLE = """crc_bits AS (SELECT b, 0 AS step, b AS c FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE step < 8),
    crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM crc_bits WHERE step = 8)"""


def crc_sql(data: str) -> str:
    """CRC-32 of a list of bytes (BIGINT[]), beside a column crcs."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def sql(views: str, query: str) -> str:
    """DuckDB SQL over the views named."""
    return "WITH " + ", ".join({"packets": PACKETS, "samples": SAMPLES, "captures": CAPTURES, "counters": COUNTERS}[v] for v in views.split()) + " " + query
