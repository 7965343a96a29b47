"""Look-ups: routes, endpoints, policies, partitioning to workers, comparison of snapshots, set operations, merges of streams.

Route and endpoint tables have at most 64 and 72 rows by the format of the device, so they are broadcast; every other join
is left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.plans.views import counters, packets, sql, table

MOST_ROUTES = 64


def small(dim: DataFrame, most: int = MOST_ROUTES) -> DataFrame:
    """dim to be broadcast; a dimension of more than `most` rows is an error when the query runs, not a large broadcast."""
    rows = dim.limit(most + 1).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy()))  # at most most + 1 rows in a window
    fits = F.when(F.col("_rows") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"a table of at most {most} rows is expected")).cast("boolean"))
    return F.broadcast(rows.filter(fits).drop("_rows"))


def spec_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """df with the lowest enabled route whose channels contain the packet's; null if none does. A count of 0 never matches."""
    r = small(routes).select("route_id", F.col("chan0").alias("r0"), (F.col("chan0") + F.col("chan_count")).alias("r1"), "endpoint_id", ((F.col("chan_count") > 0) & F.col("enable")).alias("on"))
    # Routes are few and packets many: each packet reads the small table as one array, so no rows are multiplied.
    listed = r.agg(F.array_sort(F.collect_list(F.struct("route_id", "r0", "r1", "endpoint_id", "on"))).alias("routes"))
    first = F.filter("routes", lambda x: x["on"] & (F.col("chan_count") > 0) & (F.col("chan0") >= x["r0"]) & (F.col("chan0") + F.col("chan_count") <= x["r1"]))
    out = df.join(F.broadcast(listed)).withColumn("_hit", F.get(first, F.lit(0)))
    return out.withColumns({"route_id": F.col("_hit.route_id"), "endpoint_id": F.col("_hit.endpoint_id")}).drop("routes", "_hit")


def aligned_routes(df: DataFrame, routes: DataFrame, width: int = 256) -> DataFrame:
    """The same for routes of exactly one aligned block of `width` channels: an equality join on the block."""
    r = small(routes.filter(F.col("enable") & (F.col("chan_count") == width) & (F.col("chan0") % width == 0)))
    r = r.groupBy((F.col("chan0") / width).cast("int").alias("block")).agg(F.min(F.struct("route_id", "endpoint_id")).alias("_hit"))
    block = F.when((F.col("chan0") % width == 0) & (F.col("chan_count") == width), (F.col("chan0") / width).cast("int"))
    out = df.withColumn("block", block).join(F.broadcast(r), "block", "left")
    return out.withColumns({"route_id": F.col("_hit.route_id"), "endpoint_id": F.col("_hit.endpoint_id")}).drop("block", "_hit")


def time_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """The lowest enabled route of the packet's input mask."""
    r = small(routes.filter("enable")).groupBy("input_mask").agg(F.min(F.struct("route_id", "endpoint_id")).alias("_hit"))
    out = df.join(F.broadcast(r), "input_mask", "left")
    return out.withColumns({"route_id": F.col("_hit.route_id"), "endpoint_id": F.col("_hit.endpoint_id")}).drop("_hit")


def apply_policy(df: DataFrame, endpoints: DataFrame, drop_on_miss: bool) -> DataFrame:
    """outcome of each routed packet: forward, default (a miss that goes to endpoint 0), drop, or error (its endpoint is
    disabled or unknown)."""
    e = small(endpoints, 72).select("endpoint_id", F.col("enable").alias("up"))
    target = F.coalesce("endpoint_id", F.lit(None if drop_on_miss else 0).cast("int"))
    out = df.withColumn("miss", F.col("route_id").isNull()).withColumn("endpoint_id", target).join(e, "endpoint_id", "left")
    outcome = F.when(F.col("miss") & F.lit(drop_on_miss), "drop").when(~F.coalesce("up", F.lit(False)), "error").when(F.col("miss"), "default").otherwise("forward")
    return out.withColumn("outcome", outcome).drop("up")


def hit_counts(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Packets of every route of the table, zeros kept."""
    n = df.groupBy("route_id").agg(F.count("*").alias("hits"))
    return routes.select("route_id").join(n, "route_id", "left").select("route_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def flow_endpoint(seq: Column, base: int, mask: int) -> Column:
    return F.lit(base) + seq.bitwiseAND(F.lit(mask))


def worker_of(port: Column, base: int, workers: int) -> Column:
    return F.pmod(port - base, F.lit(workers)).cast("int")


def deal_to_workers(df: DataFrame, base: int, workers: int) -> DataFrame:
    """df partitioned so that a port's packets are together."""
    return df.withColumn("worker_id", worker_of(F.col("dst_port"), base, workers)).repartition(workers, "worker_id")


def mismatches(asked: DataFrame, read: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key which fields differ between what was asked and what is read back, or which side has no row."""
    a, b = asked.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("asked")), read.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("read"))
    said = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    out = a.join(b, key, "full_outer").withColumn("differs", F.when(F.col("asked").isNull(), F.array(F.lit("unasked"))).when(F.col("read").isNull(), F.array(F.lit("missing"))).otherwise(said))
    return out.filter(F.size("differs") > 0).select(key, F.array_join("differs", ",").alias("differs"))


def before_after(before: DataFrame, after: DataFrame, active: list[int]) -> DataFrame:
    """Per flow the packets between two snapshots and the code of what is wrong: an active flow is missing or idle, or an
    inactive one has packets."""
    b, a = before.select("flow_id", F.col("packets").alias("b")), after.select("flow_id", F.col("packets").alias("a"))
    out = b.join(a, "flow_id", "full_outer").withColumn("delta", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    on = F.col("flow_id").isin(*active)
    code = F.when(on & F.col("a").isNull(), "MISSING").when(on & (F.col("delta") <= 0), "NO_PACKETS").when(~on & (F.col("delta") != 0), "INACTIVE_PACKETS")
    return out.select("flow_id", "delta", code.alias("code"))


def duplicate_tuples(endpoints: DataFrame) -> DataFrame:
    """Enabled endpoints that repeat the address and port of one with a lower id, and that id."""
    first = endpoints.filter("enable").groupBy("ip", "port").agg(F.min("endpoint_id").alias("first_id"))
    return endpoints.filter("enable").join(first, ["ip", "port"]).filter("endpoint_id > first_id").select("endpoint_id", "first_id", "ip", "port")


def arbitrate(*streams: DataFrame, slot: str = "slot") -> DataFrame:
    """Streams merged by strict priority, in order of the arguments, within each slot."""
    out = None
    for p, s in enumerate(streams):
        s = s.withColumn("priority", F.lit(p))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("turn", F.row_number().over(Window.partitionBy(slot).orderBy("priority", "seq_no")))


def round_robin(*streams: DataFrame, lane: str = "flow_id") -> DataFrame:
    """Streams merged by turns within each lane: the k-th of each stream before the k + 1-th of any."""
    out = None
    for p, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(p)).withColumn("round", F.row_number().over(Window.partitionBy(lane).orderBy("seq_no")))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("turn", F.row_number().over(Window.partitionBy(lane).orderBy("round", "stream")))


def fan_out(df: DataFrame, branches: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each branch that is enabled, and whether it is taken: a branch that may drop loses rows while full.
    branches: name -> (enabled, full and may drop)."""
    each = F.array(*[F.struct(F.lit(n).alias("branch"), on.alias("enabled"), lost.alias("dropped")) for n, (on, lost) in branches.items()])
    return df.select("*", F.explode(each).alias("b")).filter("b.enabled").select(*df.columns, "b.branch", "b.dropped")


def _routes(spark: SparkSession) -> DataFrame:
    """Sixteen aligned routes, one that overlaps, one of no channels, one disabled."""
    rows = [(i, i != 5, i * 256, 256, i % 12) for i in range(14)] + [(14, True, 0, 4096, 12), (15, True, 3584, 0, 1)]
    return spark.createDataFrame(rows, "route_id int, enable boolean, chan0 int, chan_count int, endpoint_id int")


_ROUTES = "routes AS (SELECT i::INTEGER AS route_id, i <> 5 AS enable, (CASE i WHEN 14 THEN 0 WHEN 15 THEN 3584 ELSE i * 256 END)::INTEGER AS r0, (CASE i WHEN 14 THEN 4096 WHEN 15 THEN 0 ELSE 256 END)::INTEGER AS rn, (CASE i WHEN 14 THEN 12 WHEN 15 THEN 1 ELSE i % 12 END)::INTEGER AS endpoint_id FROM range(16) t(i))"
_RANGE = _ROUTES + ", routed AS (SELECT p.e, p.seq_no, r.* FROM packets p LEFT JOIN (SELECT e, min(route_id) AS route_id FROM packets, routes WHERE enable AND rn > 0 AND chan_count > 0 AND chan0 >= r0 AND chan0 + chan_count <= r0 + rn GROUP BY e) m USING (e) LEFT JOIN routes r ON r.route_id = m.route_id)"


def _endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, i not in (3, 12)) for i in range(13)], "endpoint_id int, enable boolean")


def q_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_routes(packets(spark, sf_dir), _routes(spark)).select("e", "route_id", "endpoint_id")


def q_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_routes(packets(spark, sf_dir), _routes(spark)).select("e", "route_id", "endpoint_id")


def q_time_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([(i, i != 2, (i % 3 + 1) * 15, i + 1) for i in range(8)], "route_id int, enable boolean, input_mask int, endpoint_id int")
    return time_routes(packets(spark, sf_dir).select("e", (F.col("flow_id") * 15).alias("input_mask")), routes).select("e", "route_id", "endpoint_id")


def _policy(drop: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = apply_policy(spec_routes(packets(spark, sf_dir), _routes(spark).filter("route_id <> 14")), _endpoints(spark), drop)
        return out.groupBy("outcome").agg(F.count("*").alias("packets"))

    return run


def q_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_counts(spec_routes(packets(spark, sf_dir), _routes(spark)), _routes(spark))


def q_multiflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).withColumn("endpoint_id", flow_endpoint(F.col("seq_no"), 0, 7).cast("int"))
    return df.join(F.broadcast(_endpoints(spark)), "endpoint_id").groupBy("endpoint_id", "enable").agg(F.count("*").alias("packets"))


def q_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal_to_workers(packets(spark, sf_dir), 4300, 6).groupBy("worker_id").agg(F.count("*").alias("packets"), F.countDistinct("dst_port").alias("ports"))


def q_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select(F.col("e").alias("id"), F.col("dst_port").alias("port"), "board_id")
    read = p.filter("id % 50 <> 7").withColumn("port", F.when(F.col("id") % 31 == 0, F.col("port") + 1).otherwise(F.col("port")))
    read = read.withColumn("board_id", F.when(F.col("id") % 62 == 0, None).otherwise(F.col("board_id")))
    return mismatches(p.filter("id % 50 <> 8"), read, "id", ["port", "board_id"])


def q_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("flow_id", F.col("dst_port") - 4300)
    half = table(spark, sf_dir, "events").agg((F.max("event_id") / 2).alias("h"))
    before = p.join(F.broadcast(half)).filter("e < h and flow_id <> 3").groupBy("flow_id").agg(F.count("*").alias("packets"))
    return before_after(before, p.filter("flow_id not in (4, 20)").groupBy("flow_id").agg(F.count("*").alias("packets")), list(range(8)))


def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packets(spark, sf_dir).select(F.col("e").alias("endpoint_id"), (F.col("e") % 5 != 0).alias("enable"), F.col("board_id").alias("ip"), F.col("dst_port").alias("port"))
    return duplicate_tuples(e)


def inactive(known: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """The keys of known that active lacks, each once; a null key is never active. Keys are made distinct before they meet, so a
    key of many rows is one row of the join."""
    return known.select(key).distinct().join(active.select(key).distinct(), key, "left_anti")


def key_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of either snapshot, each once."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def q_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows without the active ones."""
    p = packets(spark, sf_dir).select((F.col("dst_port") - 4300).alias("flow_id"), "stream_type", "e")
    return inactive(p, p.filter("stream_type = 1 and e % 48 < 20"), "flow_id")


def q_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counters(spark, sf_dir)
    return key_union(c.filter("board_id = 0"), c.filter("board_id = 1"), ["day"])


def _streams(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    p = packets(spark, sf_dir).select("seq_no", "flow_id", "stream_type", (F.floor(F.col("e") / 32)).alias("slot"))
    return [p.filter(F.col("stream_type") == t) for t in (0, 1, 2)]


def q_arbiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrate(*_streams(spark, sf_dir)).select("slot", "turn", "seq_no", "stream_type")


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    heartbeat, time, spec = _streams(spark, sf_dir)[2], _streams(spark, sf_dir)[1], _streams(spark, sf_dir)[0]
    return round_robin(heartbeat, time, spec).select("flow_id", "turn", "seq_no", "stream_type")


def q_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.col("e") % 10 == 0
    out = fan_out(packets(spark, sf_dir), {"spec": (F.col("stream_type") == 0, F.lit(False)), "time": (F.col("stream_type") == 1, full), "snapshot": (F.col("e") % 2 == 0, full), "monitor": (F.lit(True), F.lit(False))})
    return out.groupBy("branch").agg(F.count("*").alias("offered"), F.count(F.when(F.col("dropped"), 1)).alias("dropped"))


QUERIES = {
    "route_match_range": q_range, "route_match_aligned": q_aligned, "time_route_match": q_time_routes, "endpoint_policy_default": _policy(False), "endpoint_policy_drop": _policy(True),
    "hit_counts": q_hits, "multiflow_endpoint": q_multiflow, "worker_partition": q_workers, "readback_mismatch": q_readback, "before_after_flows": q_before_after,
    "dup_tuple": q_duplicates, "inactive_flows": q_inactive, "key_union": q_key_union, "arbiter_priority": q_arbiter, "arbiter_rr": q_round_robin, "fan_out": q_fan_out,
}


def _over(more: str, query: str) -> str:
    return sql("packets", "").strip() + ", " + more + " " + query


def _policy_sql(drop: bool) -> str:
    target = "endpoint_id" if drop else "coalesce(endpoint_id, 0)"
    return _over(_RANGE.replace("WHERE enable AND", "WHERE route_id <> 14 AND enable AND"), f"""SELECT CASE WHEN route_id IS NULL AND {str(drop).lower()} THEN 'drop' WHEN t IN (3, 12) OR t IS NULL THEN 'error' WHEN route_id IS NULL THEN 'default' ELSE 'forward' END AS outcome, count(*) AS packets
        FROM (SELECT *, {target} AS t FROM routed) GROUP BY outcome""")


_MERGE = "FROM (SELECT seq_no, flow_id, stream_type, e // 32 AS slot FROM packets)"
SQL = {
    "route_match_range": _over(_RANGE, "SELECT e, route_id, endpoint_id FROM routed"),
    "route_match_aligned": _over(_ROUTES, "SELECT e, route_id, endpoint_id FROM packets LEFT JOIN (SELECT * FROM routes WHERE enable AND rn = 256) r ON chan0 % 256 = 0 AND chan_count = 256 AND chan0 = r0"),
    "time_route_match": sql("packets", "SELECT e, route_id, endpoint_id FROM (SELECT e, flow_id * 15 AS m FROM packets) LEFT JOIN (SELECT (i % 3 + 1) * 15 AS m, min(i)::INTEGER AS route_id, (min(i) + 1)::INTEGER AS endpoint_id FROM range(8) t(i) WHERE i <> 2 GROUP BY 1) USING (m)"),
    "endpoint_policy_default": _policy_sql(False),
    "endpoint_policy_drop": _policy_sql(True),
    "hit_counts": _over(_RANGE, "SELECT r.route_id, count(d.e) AS hits FROM routes r LEFT JOIN routed d ON d.route_id = r.route_id GROUP BY r.route_id"),
    "multiflow_endpoint": sql("packets", "SELECT (seq_no & 7)::INTEGER AS endpoint_id, (seq_no & 7) NOT IN (3, 12) AS enable, count(*) AS packets FROM packets GROUP BY ALL"),
    "worker_partition": sql("packets", "SELECT ((dst_port - 4300) % 6)::INTEGER AS worker_id, count(*) AS packets, count(DISTINCT dst_port) AS ports FROM packets GROUP BY 1"),
    "readback_mismatch": sql("packets", """SELECT id, differs FROM (SELECT coalesce(a.e, b.e) AS id, CASE WHEN a.e IS NULL THEN 'unasked' WHEN b.e IS NULL THEN 'missing' ELSE concat_ws(',', CASE WHEN a.e % 31 = 0 THEN 'port' END, CASE WHEN a.e % 62 = 0 THEN 'board_id' END) END AS differs
        FROM (SELECT e FROM packets WHERE e % 50 <> 8) a FULL JOIN (SELECT e FROM packets WHERE e % 50 <> 7) b ON a.e = b.e) WHERE differs <> ''"""),
    "before_after_flows": sql("packets", """SELECT flow_id, delta, CASE WHEN flow_id < 8 AND a IS NULL THEN 'MISSING' WHEN flow_id < 8 AND delta <= 0 THEN 'NO_PACKETS' WHEN flow_id >= 8 AND delta <> 0 THEN 'INACTIVE_PACKETS' END AS code
        FROM (SELECT coalesce(b.f, a.f) AS flow_id, a.n AS a, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT dst_port - 4300 AS f, count(*) AS n FROM packets WHERE e < (SELECT max(event_id) / 2 FROM events) AND dst_port <> 4303 GROUP BY 1) b
        FULL JOIN (SELECT dst_port - 4300 AS f, count(*) AS n FROM packets WHERE dst_port NOT IN (4304, 4320) GROUP BY 1) a ON a.f = b.f)"""),
    "dup_tuple": sql("packets", "SELECT endpoint_id, first_id, ip, port FROM (SELECT e AS endpoint_id, board_id AS ip, dst_port AS port, min(e) OVER (PARTITION BY board_id, dst_port) AS first_id FROM packets WHERE e % 5 <> 0) WHERE endpoint_id > first_id"),
    "inactive_flows": sql("packets", "SELECT DISTINCT dst_port - 4300 AS flow_id FROM packets EXCEPT SELECT dst_port - 4300 FROM packets WHERE stream_type = 1 AND e % 48 < 20"),
    "key_union": sql("counters", "SELECT day FROM counters WHERE board_id = 0 UNION SELECT day FROM counters WHERE board_id = 1"),
    "arbiter_priority": sql("packets", f"SELECT slot, (row_number() OVER (PARTITION BY slot ORDER BY stream_type, seq_no))::INTEGER AS turn, seq_no, stream_type {_MERGE}"),
    "arbiter_rr": sql("packets", f"""SELECT flow_id, (row_number() OVER (PARTITION BY flow_id ORDER BY r, CASE stream_type WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END))::INTEGER AS turn, seq_no, stream_type
        FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, stream_type ORDER BY seq_no) AS r {_MERGE})"""),
    "fan_out": sql("packets", """SELECT 'spec' AS branch, count(*) AS offered, 0::BIGINT AS dropped FROM packets WHERE stream_type = 0 UNION ALL SELECT 'time', count(*), count(*) FILTER (e % 10 = 0) FROM packets WHERE stream_type = 1
        UNION ALL SELECT 'snapshot', count(*), count(*) FILTER (e % 10 = 0) FROM packets WHERE e % 2 = 0 UNION ALL SELECT 'monitor', count(*), 0 FROM packets"""),
}
