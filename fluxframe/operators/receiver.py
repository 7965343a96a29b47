"""Queries of the receiver's stateful operators over tables; the machines are those of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.operators.gates import SYNC_START, epoch_step, sync_step
from fluxframe.plans.views import CRC_TABLE, crc_sql, packets, sql, stepped
from fluxframe.sources.captures import to_binary
from fluxframe.streaming.keyed import assembled
from fluxframe.streaming.receiver import Arbiter, Capture, PreviewGate, Reorder, Ring, Steps, run_batch, stale

REORDER = "key int, released long, late long, seq_gaps long, frame_gaps long, sample0_gaps long, app_drops long, last_seq long, detected_mhz int"


def scattered(blocks: DataFrame) -> DataFrame:
    """The values of whole spectra from blocks (frame_id, block_index, block_count, chan0, nchan, seq_no, input, power_db:
    array): of each frame group whose blocks are all there, the channel chan0 + k of each input has the k-th value, the last
    packet's of several. No group is gathered: values are rows."""
    b = blocks.withColumn("frame_group", F.expr("frame_id div block_count")).filter(F.col("block_index") < F.col("block_count"))
    whole = b.groupBy("frame_group", "block_count").agg(F.count_distinct("block_index").alias("seen")).filter(F.col("seen") >= F.col("block_count")).drop("seen")
    cells = b.join(whole, ["frame_group", "block_count"]).select("frame_group", "input", "chan0", "nchan", "seq_no", F.posexplode("power_db").alias("k", "v"))
    cells = cells.withColumn("chan", F.col("chan0") + F.col("k")).filter(F.col("chan") < F.col("nchan"))
    return cells.groupBy("frame_group", "input", "chan").agg(F.max_by("v", "seq_no").alias("power_db"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each flow with numbers of their own, k, as they arrive: neighbours swapped here and there, and numbers that
    leap by three every 97 packets."""
    p = packets(spark, sf_dir).withColumn("k", F.expr("e div 8 + e div 776 * 3"))
    return p.select("flow_id", (F.col("e") * 10 + F.when(F.expr("e div 8 % 10 = 4"), 105).otherwise(0)).alias("arrival"), F.col("k").alias("seq_no"), F.col("k").alias("frame_id"), (F.col("k") * 512).alias("sample0"), F.lit(64).alias("time_count"))


def q_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch(_flows(spark, sf_dir), "flow_id", "arrival", lambda s: Reorder(2, 100, s), REORDER, True).withColumnRenamed("key", "flow_id")


def q_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets a window of 0 refuses as late: those that a newer one overtook."""
    return run_batch(_flows(spark, sf_dir), "flow_id", "arrival", lambda s: Reorder(0, 100, s), REORDER, True).select(F.col("key").alias("flow_id"), "late", "released")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two layouts, 16 and 64 a frame group; some come twice in the place of another."""
    p = packets(spark, sf_dir).select("e", F.explode(F.array(F.lit(16), F.lit(64))).alias("block_count"))
    at = F.col("e") % F.col("block_count")
    return p.select("e", F.col("e").alias("frame_id"), "block_count", (at - F.when((F.col("e") % 67 == 0) & (at > 0), 1).otherwise(0)).cast("int").alias("block_index"))


def q_assembler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(_blocks(spark, sf_dir), [], "e").filter("complete").drop("complete")


def q_given_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame groups of each board that never become whole, and what they have."""
    b = _blocks(spark, sf_dir).withColumn("board_id", (F.col("e") % 3).cast("int"))
    return assembled(b.withColumn("frame_id", F.expr("e div 3")).withColumn("block_index", F.expr("cast((e div 3) % block_count - if((e div 3) % 41 = 7 and (e div 3) % block_count > 0, 1, 0) as int)")), ["board_id"], "e").filter("not complete").drop("frame_id", "complete")


def q_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 4 channels for two inputs, put together; sums that tell each channel's place."""
    b = _blocks(spark, sf_dir).withColumn("input", F.explode(F.array(F.lit(0), F.lit(1))))
    b = b.withColumns({"seq_no": F.col("e"), "chan0": F.col("block_index") * 4, "nchan": F.col("block_count") * 4, "power_db": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("e") * 7 + F.col("input") * 3 + k).cast("double"))})
    out = scattered(b.filter("block_count = 16"))
    return out.groupBy("frame_group", "input").agg(F.count("*").alias("channels"), F.sum(F.col("power_db") * (F.col("chan") + 1)).cast("long").alias("by_place"))


def q_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_batch(_flows(spark, sf_dir).select("flow_id", "arrival", "seq_no"), "flow_id", "arrival", lambda s: Capture(16, 1, 24, s), "key int, first long, last long, packets long")
    return out.withColumnRenamed("key", "flow_id")


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("board_id", "e", "seq_no", F.col("e").alias("frame_id"), F.lit(16).alias("block_count"), F.expr("cast(e % 16 as int)").alias("block_index"), (F.col("e") * 10).alias("t_ms"))
    return run_batch(df, "board_id", "e", lambda s: PreviewGate(3, 100, 500, s), "key int, frame_group long, block_index int, seq_no long").withColumnRenamed("key", "board_id")


def q_arbiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of four streams to each board's link; how long each waits."""
    p = packets(spark, sf_dir).select("board_id", F.col("e").alias("id"), (F.col("e") * 3).alias("arrival"), F.when(F.col("stream_type") == 0, 0).when(F.col("stream_type") == 1, 1).otherwise(2 + F.col("e") % 2).cast("long").alias("priority"), (F.col("e") * 7 % 19 + 1).alias("beats"))
    out = run_batch(p, "board_id", "arrival", lambda s: Arbiter(s), "key int, id long, priority long, start long")
    return out.select(F.col("key").alias("board_id"), "id", "priority", (F.col("start") - F.col("id") * 3).alias("waited"))


def q_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and reads of each board's ring of 6 frames."""
    df = packets(spark, sf_dir).select("board_id", "e", (F.col("e") * 31 % 100 < 55).alias("write"))
    return run_batch(df, "board_id", "e", lambda s: Ring(6, s), "key int, kept long, dropped long, high_water long", True).withColumnRenamed("key", "board_id")


def _sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven events a board, a start as planned, with something wrong on most boards: which is the board's number modulo 14."""
    kinds = F.array(*map(F.lit, ["prepare", "arm", "pps", "pps", "adc", "science", "science"]))
    df = packets(spark, sf_dir).select(F.expr("cast(e div 7 as int)").alias("board"), F.expr("cast(e % 7 as int)").alias("tick")).withColumn("event", F.get(kinds, "tick"))
    case, tick = F.col("board") % 14, F.col("tick")
    return df.withColumns({
        "generation": F.when(case == 3, 0).otherwise(5), "target_pps": F.when(case == 9, 11).otherwise(13), "epoch_tai": F.when(case == 13, 0).otherwise(1), "first_sample0": F.when(case == 2, 3).otherwise(800), "signal_chain_tag": F.when(case == 12, 0).otherwise(1), "mts_result_id": F.when(case == 4, 0).otherwise(1),
        "ref_locked": ~((case == 5) & (tick >= 1)), "rfdc_ready": ~((case == 6) & (tick >= 2)), "pps_recent": ~((case == 7) & (tick >= 4)),
        "pps_count": F.when(tick < 2, 10).when(tick == 2, 12).otherwise(F.when(case == 10, 14).otherwise(13)), "sample0": F.when(tick == 4, 1000).when(tick == 5, 792).otherwise(F.when(case == 11, 808).otherwise(800)),
        "event": F.when((case == 1) & (tick == 1), "prepare").when((case == 8) & (tick == 0), "pps").otherwise(F.col("event")),
    })


def q_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch(_sync_events(spark, sf_dir), "board", "tick", lambda s: Steps(SYNC_START, sync_step, "tick", s), "key int, tick int, state string, error int").withColumnRenamed("key", "board")


def q_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start-up machine of each user's events: every flag is a bit of a hash of the event."""
    e = F.col("e")
    bits = {n: F.shiftright(e * 7919, k).bitwiseAND(F.lit(7)) != 0 for k, n in enumerate(["arm", "ref_locked", "rfdc_ready"])} | {n: e % m == 0 for n, m in (("sync_error", 47), ("stop", 29), ("reset", 61), ("pps", 3), ("soft", 5))}
    df = packets(spark, sf_dir).select("e", F.col("user_id").alias("machine"), F.get(F.array(*map(F.lit, ["external", "software", "free_run"])), (F.col("user_id") % 3).cast("int")).alias("mode"), *[c.alias(n) for n, c in bits.items()])
    return run_batch(df, "machine", "e", lambda s: Steps("RESET", epoch_step, "e", s), "key long, e long, state string, error int").withColumnRenamed("key", "machine")


def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = packets(spark, sf_dir).select("e", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("e") % 5).alias("updated"), F.when(F.col("e") % 2 == 0, "waveform").otherwise("spectrum").alias("kind"), (F.col("e") % 300 * 1000).alias("pps"), F.lit(480_000).alias("expected_pps"))
    return stale(df, F.timestamp_seconds(F.lit(1_700_000_005))).select("e", "kind")


def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display messages of spectra, and their size and digest."""
    p = packets(spark, sf_dir)
    lane = F.struct(*[F.array(*[(F.col("e") % 7 + k).cast("double") for k in range(4)]).alias(a) for a in ("amplitude", "phase_rad", "power_db")])
    df = p.select("e", "sample0", "frame_id", "seq_no", "chan0", "chan_count", F.array(lane, lane).alias("lanes"), F.lit(65535).cast("long").alias("coverage_lo"))
    return to_binary(df, "spectrum").select("e", F.length("message").alias("bytes"), F.decode(F.substring("message", 1, 4), "US-ASCII").alias("magic"), F.crc32("message").alias("crc"))


QUERIES = {
    "reorder_buffer": q_reorder, "late_packets": q_late, "spectrum_assembler": q_assembler, "groups_given_up": q_given_up, "spectrum_scatter": q_scattered, "display_capture": q_capture, "preview_gate": q_preview, "ring_buffer": q_ring, "arbiter_locked": q_arbiter, "sync_scheduler": q_sync, "epoch_machine": q_epoch,
    "stale_previews": q_stale, "spectrum_messages": q_messages,
}

# Numbered events of each key, then a row for each step of its machine: an event taken, or a step within.
_ARRIVALS = "ev AS (SELECT flow_id, e // 8 + e // 776 * 3 AS k, row_number() OVER (PARTITION BY flow_id ORDER BY e * 10 + CASE WHEN e // 8 % 10 = 4 THEN 105 ELSE 0 END) AS n FROM packets)"


def _reorder_sql(window: int) -> str:
    """Frames, samples and numbers advance alike, so a leap between released packets is a gap of frames and samples."""
    return _ARRIVALS + f""", r AS (
        SELECT flow_id, 0 AS step, 0::BIGINT AS n, NULL::BIGINT AS expected, []::BIGINT[] AS held, NULL::BIGINT AS prev, 0 AS released, 0 AS late, 0 AS seq_gaps, 0 AS frame_gaps, 0::BIGINT AS app_drops, 0 AS inferred FROM ev WHERE n = 1
        UNION ALL
        SELECT flow_id, step + 1, CASE WHEN inside THEN n ELSE n + 1 END,
            CASE WHEN next THEN expected + 1 WHEN leap THEN low ELSE coalesce(expected, k) END,
            CASE WHEN next THEN list_filter(held, lambda x: x <> expected) WHEN leap OR list_contains(held, k) OR k < expected THEN held ELSE list_append(held, k) END,
            CASE WHEN next THEN expected ELSE prev END, released + next::INTEGER, late + (NOT inside AND coalesce(k < expected, false))::INTEGER, seq_gaps + leap::INTEGER,
            frame_gaps + (next AND prev IS NOT NULL AND expected <> prev + 1)::INTEGER, app_drops + CASE WHEN leap THEN least(low - expected, 1000000) ELSE 0 END, inferred + (next AND prev IS NOT NULL AND expected = prev + 1)::INTEGER
        FROM (SELECT *, next OR leap AS inside FROM (
            SELECT r.*, ev.k, list_min(held) AS low, coalesce(list_contains(held, expected), false) AS next, coalesce(NOT list_contains(held, expected) AND list_min(held) - expected > {window}, false) AS leap
            FROM r LEFT JOIN ev ON ev.flow_id = r.flow_id AND ev.n = r.n + 1))
        WHERE inside OR k IS NOT NULL
    ), done AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY step DESC) = 1)"""


_CAPTURE = _ARRIVALS + """, r AS (
        SELECT flow_id, 0::BIGINT AS n, NULL::BIGINT AS start, []::BIGINT[] AS held, NULL::BIGINT AS first, 0::BIGINT AS packets FROM ev WHERE n = 1
        UNION ALL
        SELECT flow_id, n, CASE WHEN full_ THEN NULL ELSE s END, CASE WHEN full_ THEN [] ELSE h END, CASE WHEN full_ THEN s END, got FROM (
            SELECT *, k >= s AND (got = 16 OR len(h) >= 24) AS full_ FROM (
                SELECT *, coalesce(list_min(list_filter(range(16), lambda x: NOT list_contains(h, s + x))), 16) AS got FROM (
                    SELECT r.flow_id, ev.n, ev.k, coalesce(start, k) AS s, CASE WHEN list_contains(held, k) OR k < coalesce(start, k) THEN held ELSE list_append(held, k) END AS h FROM r JOIN ev ON ev.flow_id = r.flow_id AND ev.n = r.n + 1)))
    )"""

_PREVIEW = """ev AS (SELECT board_id, e, seq_no, e // 16 AS g, e % 16 AS b, e * 10 AS t, row_number() OVER (PARTITION BY board_id ORDER BY e) AS n FROM packets),
    r AS (
        SELECT board_id, 0::BIGINT AS n, NULL::BIGINT AS target, 0::BIGINT AS mask, 0::BIGINT AS armed, NULL::BIGINT AS hit, false AS taken FROM ev WHERE n = 1
        UNION ALL
        SELECT board_id, n, CASE WHEN chosen THEN g + 3 ELSE target END, CASE WHEN chosen THEN 0 WHEN take THEN mask | (1::BIGINT << b) ELSE mask END, CASE WHEN chosen THEN t ELSE armed END, CASE WHEN chosen THEN NULL WHEN take THEN coalesce(hit, t) ELSE hit END, take FROM (
            SELECT r.board_id, ev.n, g, b, t, target, mask, armed, hit, target IS NULL OR g > target AND t - armed >= 100 AND coalesce(t - hit >= 500, true) AS chosen, coalesce(g = target AND mask & (1::BIGINT << b) = 0, false) AS take
            FROM r JOIN ev ON ev.board_id = r.board_id AND ev.n = r.n + 1)
    )"""

_ARBITER = """ev AS (SELECT board_id, e AS id, e * 3 AS a, CASE WHEN stream_type = 0 THEN 0 WHEN stream_type = 1 THEN 1 ELSE 2 + e % 2 END AS p, e * 7 % 19 + 1 AS beats, row_number() OVER (PARTITION BY board_id ORDER BY e) AS n FROM packets),
    r AS (
        SELECT board_id, 0::BIGINT AS n, 0::BIGINT AS step, 0::BIGINT AS free, []::STRUCT(p BIGINT, a BIGINT, id BIGINT, beats BIGINT)[] AS waiting, NULL::STRUCT(p BIGINT, a BIGINT, id BIGINT, beats BIGINT) AS sent, NULL::BIGINT AS start FROM ev WHERE n = 1
        UNION ALL
        SELECT board_id, CASE WHEN serve THEN n ELSE n + 1 END, step + 1, CASE WHEN serve THEN at_ + best.beats ELSE free END, CASE WHEN serve THEN list_filter(waiting, lambda w: w.id <> best.id) ELSE list_append(waiting, new) END, CASE WHEN serve THEN best END, CASE WHEN serve THEN at_ END
        FROM (SELECT *, len(waiting) > 0 AND (new IS NULL OR at_ < new.a) AS serve FROM (
            SELECT *, list_min(list_filter(waiting, lambda w: w.a <= at_)) AS best FROM (
                SELECT r.*, CASE WHEN ev.id IS NOT NULL THEN {'p': ev.p::BIGINT, 'a': ev.a, 'id': ev.id, 'beats': ev.beats} END AS new, greatest(free, list_min(list_transform(waiting, lambda w: w.a))) AS at_ FROM r LEFT JOIN ev ON ev.board_id = r.board_id AND ev.n = r.n + 1)))
        WHERE new IS NOT NULL OR len(waiting) > 0
    )"""

_RING = """ev AS (SELECT board_id, e * 31 % 100 < 55 AS w, row_number() OVER (PARTITION BY board_id ORDER BY e) AS n FROM packets),
    r AS (
        SELECT board_id, 0::BIGINT AS n, 0 AS level, 0::BIGINT AS kept, 0::BIGINT AS dropped, 0::BIGINT AS high FROM ev WHERE n = 1
        UNION ALL
        SELECT r.board_id, ev.n, CASE WHEN NOT w THEN greatest(0, level - 1) WHEN level < 6 THEN level + 1 ELSE level END, kept + (w AND level < 6)::INTEGER, dropped + (w AND level >= 6)::INTEGER, greatest(high, CASE WHEN w AND level < 6 THEN level + 1 ELSE 0 END)
        FROM r JOIN ev ON ev.board_id = r.board_id AND ev.n = r.n + 1
    )"""

_SYNC = """ev AS (SELECT *, CASE WHEN c = 1 AND tick = 1 THEN 'prepare' WHEN c = 8 AND tick = 0 THEN 'pps' ELSE ['prepare', 'arm', 'pps', 'pps', 'adc', 'science', 'science'][tick + 1] END AS event,
        NOT (c = 5 AND tick >= 1) AS ref, NOT (c = 6 AND tick >= 2) AS rfdc, NOT (c = 7 AND tick >= 4) AS recent, CASE WHEN tick < 2 THEN 10 WHEN tick = 2 THEN 12 WHEN c = 10 THEN 14 ELSE 13 END AS pps, CASE WHEN tick = 4 THEN 1000 WHEN tick = 5 THEN 792 WHEN c = 11 THEN 808 ELSE 800 END AS sample0
        FROM (SELECT (e // 7)::INTEGER AS board, (e % 7)::INTEGER AS tick, e // 7 % 14 AS c FROM packets)),
    r AS (
        SELECT board, -1 AS tick, 'IDLE' AS state, 0 AS error, 0 AS target FROM ev WHERE tick = 0
        UNION ALL
        SELECT board, tick, CASE WHEN code = 1 THEN state WHEN code > 0 THEN 'ERROR' WHEN event = 'prepare' THEN 'PREPARED' WHEN event = 'arm' THEN 'ARMED' WHEN event = 'pps' AND state = 'ARMED' AND pps = target THEN 'WAIT_EPOCH_SAMPLE'
            WHEN event = 'adc' AND state = 'WAIT_EPOCH_SAMPLE' THEN 'PRIMING' WHEN event = 'science' AND state = 'PRIMING' AND sample0 = 800 THEN 'STREAMING' ELSE state END,
            CASE WHEN code > 0 THEN code WHEN event = 'prepare' THEN 0 ELSE error END, CASE WHEN event = 'prepare' AND code = 0 THEN CASE WHEN c = 9 THEN 11 ELSE 13 END ELSE target END
        FROM (SELECT *, CASE WHEN event = 'prepare' THEN CASE WHEN state <> 'IDLE' THEN 1 WHEN c = 2 THEN 2 WHEN c = 3 THEN 3 WHEN c = 13 THEN 13 WHEN c = 12 THEN 12 ELSE 0 END
            WHEN event = 'arm' THEN CASE WHEN state <> 'PREPARED' THEN 8 WHEN c = 4 THEN 4 WHEN NOT ref THEN 5 WHEN NOT rfdc THEN 6 WHEN NOT recent THEN 7 WHEN target < pps + 2 THEN 9 ELSE 0 END
            WHEN state IN ('ARMED', 'WAIT_EPOCH_SAMPLE', 'PRIMING', 'STREAMING') THEN CASE WHEN NOT ref THEN 5 WHEN NOT rfdc THEN 6 WHEN NOT recent THEN 7 WHEN event = 'pps' AND state = 'ARMED' AND pps > target THEN 10 WHEN event = 'science' AND state = 'PRIMING' AND sample0 > 800 THEN 11 ELSE 0 END
            ELSE 0 END AS code FROM (SELECT ev.*, state, error, target FROM r JOIN ev ON ev.board = r.board AND ev.tick = r.tick + 1))
    )"""

_EPOCH = """ev AS (SELECT user_id AS machine, e, user_id % 3 AS mode, row_number() OVER (PARTITION BY user_id ORDER BY e) AS n, (e * 7919) & 7 <> 0 AS arm, ((e * 7919) >> 1) & 7 <> 0 AS ref, ((e * 7919) >> 2) & 7 <> 0 AS rfdc, e % 47 = 0 AS bad, e % 29 = 0 AS stop, e % 61 = 0 AS reset, e % 3 = 0 AS pps, e % 5 = 0 AS soft FROM packets),
    r AS (
        SELECT machine, 0::BIGINT AS n, 'RESET' AS state, 0::BIGINT AS e FROM ev WHERE n = 1
        UNION ALL
        SELECT r.machine, ev.n, CASE WHEN reset THEN 'RESET' WHEN state = 'RESET' THEN 'CLOCK_CONFIG' WHEN state = 'RFDC_CONFIG' THEN 'WAIT_LOCK' WHEN state = 'STOPPING' THEN 'RESET'
            WHEN state = 'CLOCK_CONFIG' THEN CASE WHEN ref THEN 'RFDC_CONFIG' ELSE state END WHEN state = 'WAIT_LOCK' THEN CASE WHEN ref AND rfdc THEN 'WAIT_PPS' ELSE state END
            WHEN state = 'WAIT_PPS' THEN CASE WHEN arm THEN 'ARMED' ELSE 'RESET' END
            WHEN state = 'ARMED' THEN CASE WHEN NOT arm THEN 'STOPPING' WHEN NOT (ref AND rfdc AND NOT bad) THEN 'ERROR' WHEN CASE mode WHEN 0 THEN pps WHEN 1 THEN soft ELSE true END THEN 'STREAMING' ELSE state END
            WHEN state = 'STREAMING' THEN CASE WHEN stop OR NOT arm THEN 'STOPPING' WHEN NOT (ref AND rfdc AND NOT bad) THEN 'ERROR' ELSE state END ELSE state END, ev.e
        FROM r JOIN ev ON ev.machine = r.machine AND ev.n = r.n + 1
    )"""

_BLOCKS = "b AS (SELECT e, bc, (e % bc - CASE WHEN e % 67 = 0 AND e % bc > 0 THEN 1 ELSE 0 END)::INTEGER AS bi, e // bc AS g FROM packets, (SELECT unnest([16, 64]) AS bc))"

def _le(x: str, size: int) -> str:
    """A number's bytes as hex, the lowest first."""
    return f"(lpad(to_hex({x}), {2 * size}, '0'))" if size == 1 else "(" + " || ".join(f"substr(lpad(to_hex({x}), {2 * size}, '0'), {2 * (size - k) - 1}, 2)" for k in range(size)) + ")"


# Words of the spectrum message as in SPECTRUM_WORDS; the floats 0 to 9 by their bytes.
_WORDS = ["seq_no", "0", "chan0", "chan_count", "0", "0", "0", "0", "2", "4", *["0"] * 10]
_FLOATS = "['00000000', '0000803f', '00000040', '00004040', '00008040', '0000a040', '0000c040', '0000e040', '00000041', '00001041']"
_LANE = "(" + " || ".join(f"{_FLOATS}[e % 7 + {k} + 1]" for k in range(4)) + ")"
_MESSAGE = " || ".join(["'545350330200 8000'".replace(" ", ""), _le("sample0", 8), _le("frame_id", 8), *(_le(w, 4) for w in _WORDS), _le("65535", 8), _le("0", 8)])

SQL = {
    "spectrum_messages": stepped("packets", CRC_TABLE + f", h AS (SELECT e, rpad({_MESSAGE}, 256, '0') || {' || '.join([_LANE] * 6)} AS x FROM packets), b AS (SELECT e, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM h)", "SELECT e, len(bytes)::INTEGER AS bytes, 'TSP3' AS magic, " + crc_sql("bytes") + " AS crc FROM b, crc_table"),
    "reorder_buffer": stepped("packets", _reorder_sql(2), "SELECT flow_id, released::BIGINT AS released, late::BIGINT AS late, seq_gaps::BIGINT AS seq_gaps, frame_gaps::BIGINT AS frame_gaps, frame_gaps::BIGINT AS sample0_gaps, app_drops, prev AS last_seq, (CASE WHEN inferred > 0 THEN 100 END)::INTEGER AS detected_mhz FROM done"),
    "late_packets": stepped("packets", _reorder_sql(0), "SELECT flow_id, late::BIGINT AS late, released::BIGINT AS released FROM done"),
    "spectrum_assembler": sql("packets", "").strip() + ", " + _BLOCKS + """, f AS (SELECT *, row_number() OVER (PARTITION BY bc, g, bi ORDER BY e) = 1 AS new FROM b), s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY bc, g ORDER BY e) AS seen FROM f)
        SELECT bc::INTEGER AS block_count, g AS frame_group, e AS frame_id, bc::INTEGER AS coverage, CASE WHEN bc = 64 THEN -1 ELSE 65535 END::BIGINT AS mask_lo, 0::BIGINT AS mask_hi FROM s WHERE new AND seen = bc""",
    "groups_given_up": sql("packets", """SELECT board_id, bc::INTEGER AS block_count, g AS frame_group, count(DISTINCT bi)::INTEGER AS coverage, coalesce(bit_or(1::BIGINT << least(bi, 62)) FILTER (bi < 63), 0) + CASE WHEN bool_or(bi = 63) THEN -9223372036854775808 ELSE 0 END::BIGINT AS mask_lo, 0::BIGINT AS mask_hi
        FROM (SELECT (e % 3)::INTEGER AS board_id, bc, (e // 3) // bc AS g, ((e // 3) % bc - CASE WHEN (e // 3) % 41 = 7 AND (e // 3) % bc > 0 THEN 1 ELSE 0 END)::INTEGER AS bi FROM packets, (SELECT unnest([16, 64]) AS bc)) GROUP BY ALL HAVING count(DISTINCT bi) < bc"""),
    "spectrum_scatter": sql("packets", "").strip() + ", " + _BLOCKS + """, w AS (SELECT g FROM b WHERE bc = 16 GROUP BY g HAVING count(DISTINCT bi) = 16), l AS (SELECT g, bi, max(e) AS e FROM b JOIN w USING (g) WHERE bc = 16 GROUP BY g, bi)
        SELECT g AS frame_group, i::INTEGER AS input, count(*) AS channels, sum((e * 7 + i * 3 + k) * (bi * 4 + k + 1))::BIGINT AS by_place FROM l, (SELECT unnest([0, 1]) AS i), (SELECT unnest(range(4)) AS k) GROUP BY g, i""",
    "display_capture": stepped("packets", _CAPTURE, "SELECT flow_id, first, first + packets - 1 AS last, packets FROM r WHERE first IS NOT NULL"),
    "preview_gate": stepped("packets", _PREVIEW, "SELECT board_id, g AS frame_group, b::INTEGER AS block_index, seq_no FROM r JOIN ev USING (board_id, n) WHERE taken"),
    "ring_buffer": stepped("packets", _RING, "SELECT board_id, kept, dropped, high AS high_water FROM r QUALIFY row_number() OVER (PARTITION BY board_id ORDER BY n DESC) = 1"),
    "arbiter_locked": stepped("packets", _ARBITER, "SELECT board_id, sent.id AS id, sent.p AS priority, start - sent.id * 3 AS waited FROM r WHERE start IS NOT NULL"),
    "sync_scheduler": stepped("packets", _SYNC, "SELECT board, tick, state, error FROM r WHERE tick >= 0"),
    "epoch_machine": stepped("packets", _EPOCH, "SELECT machine, e, state, 0::INTEGER AS error FROM r WHERE n > 0"),
    "stale_previews": sql("packets", "SELECT e, CASE WHEN e % 2 = 0 THEN 'waveform' ELSE 'spectrum' END AS kind FROM packets WHERE 5 - e % 5 > 2 OR (e % 2 = 0 AND e % 300 * 1000 < 120000)"),
}
