"""Stateful streams with state by parts and timers, against tables and the machines."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fluxframe.streaming import keyed
from fluxframe.streaming.receiver import Reorder, run_batch, run_stream


class Feed:
    """A stream of files, one a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def put(self, rows):
        self.n += 1
        names = [c.split()[0] for c in self.schema.split(", ")]
        (self.folder / f"{self.n}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        (self.folder / f"{self.n}.json").rename(self.folder / "in" / f"{self.n}.json")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))

    def start(self, out, name, mode="append", **trigger):
        return out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(self.folder / name)).trigger(**trigger or {"availableNow": True}).start()


def soon(done, seconds=90):
    """Waits for a stream that has batches as long as it runs, as timers do."""
    end = time.time() + seconds
    while time.time() < end and not done():
        time.sleep(0.5)


PACKETS = "flow_id int, arrival long, seq_no long, frame_id long, sample0 long, time_count int"


def test_reordering_with_keyed_state(spark, tmp_path):
    """A hole at the start keeps packets held over batches: the same counts as over a table, and as of the machine that rewrites
    its state."""
    feed = Feed(spark, tmp_path, PACKETS)
    numbers = [0, *range(2, 900), 1, *range(900, 1200), *range(1210, 1300), 40, *range(1300, 1400), 1401, 1400, 11000, 11001]
    rows = [(1, k, s, s, s * 256, 64) for k, s in enumerate(numbers)] + [(2, k, s, s, s * 256, 64) for k, s in enumerate([5, 3, 7, 6])]
    rows.sort(key=lambda r: r[1])
    for lo in range(0, len(rows), 200):
        feed.put(rows[lo : lo + 200])
        time.sleep(0.05)
    table = spark.createDataFrame(rows, PACKETS)
    want = {tuple(r) for r in run_batch(table, "flow_id", "arrival", lambda s: Reorder(8192, 200, s), keyed.REORDERED, True).collect()}
    for name, make in (("by_part", lambda s: keyed.reordered(s, "flow_id", "arrival", 8192, 200)), ("whole", lambda s: run_stream(s, "flow_id", "arrival", lambda x: Reorder(8192, 200, x), keyed.REORDERED, True))):
        q = feed.start(make(feed.stream()), name, "update")
        q.awaitTermination(300)
        last = {}
        for r in spark.table(name).collect():
            if r.key not in last or (r.released + r.late) >= (last[r.key][1] + last[r.key][2]):
                last[r.key] = tuple(r)
        assert set(last.values()) == want
    assert {r[0] for r in want} == {1, 2}


class Map(dict):
    """A map state that counts what is written to it."""

    written = 0

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        self.written += len(value[0])

    def removeKey(self, key):
        del self[key]


def test_a_batch_writes_what_moves():
    """8000 packets wait for the first over 80 batches: each is written once, where the machine's state is written 80 times."""
    packets, small, whole, runs = Map(), 0, 0, []
    machine = Reorder(8192, 200)
    numbers = [0, *range(2, 8002)]
    for lo in range(0, len(numbers), 100):
        held = keyed.Held(packets, json.loads(json.dumps(runs)))
        for n in numbers[lo : lo + 100]:
            p = {"seq_no": n, "frame_id": n, "sample0": 256 * n, "time_count": 64}
            machine.feed(p)
            if n:
                held.add(n, p)
        held.flush()
        runs = held.runs
        small, whole = small + len(json.dumps(runs)), whole + len(json.dumps(machine.s))
    assert runs == [[2, 8001]] and len(packets) == 8000
    assert packets.written + small < whole / 30
    held = keyed.Held(packets, runs)
    assert [held.pop()["seq_no"] for _ in range(8000)] == numbers[1:] and not packets and not held.runs


@pytest.mark.parametrize("seed", range(5))
def test_held_runs(seed):
    rng, held, want = random.Random(seed), keyed.Held(Map(), []), set()
    for _ in range(300):
        place = rng.randint(0, 60)
        held.add(place, {"seq_no": place})
        want.add(place)
        if rng.random() < 0.3:
            assert held.pop()["seq_no"] == min(want)
            want.remove(min(want))
        if rng.random() < 0.2:
            held.flush()
            held = keyed.Held(held.packets, held.runs)
        assert [x for a, b in held.runs for x in range(a, b + 1)] == sorted(want)
        assert all(b + 1 < c for (_, b), (c, _) in zip(held.runs, held.runs[1:]))


def test_assembled_stream(spark, tmp_path):
    """Whole groups are given out once, as over the table; a repeat is none; a group that stays open is given up by its timer."""
    schema = "board_id int, e long, frame_id long, block_index int, block_count int"
    feed = Feed(spark, tmp_path, schema)
    rows = [(b, 100 * b + k, k, k % 4, 4) for b in (1, 2) for k in range(12) if (b, k) != (2, 6)] + [(1, 400, 3, 3, 4), (1, 401, 0, 9, 4)]
    q = feed.start(keyed.assembled_stream(feed.stream(), ["board_id"], "e", 20), "groups", processingTime="300 milliseconds")
    for lo in range(0, len(rows), 9):
        feed.put(rows[lo : lo + 9])
        time.sleep(1.1)  # files are taken in order of their times
    soon(lambda: spark.table("groups").filter("complete").count() == 5)
    table = keyed.assembled(spark.createDataFrame(rows, schema), ["board_id"], "e")
    assert {tuple(r) for r in spark.table("groups").collect() if r.complete} == {tuple(r) for r in table.filter("complete").collect()}
    assert table.count() == 6
    soon(lambda: not spark.table("groups").filter("not complete").isEmpty())
    given_up = spark.table("groups").filter("not complete").collect()
    q.stop()
    assert [tuple(r) for r in given_up] == [tuple(r) for r in table.filter("not complete").collect()] == [(2, 1, 4, None, 3, 11, 0, False)]


def test_silence_clears(spark, tmp_path):
    """A preview that isn't updated is cleared after two seconds with no data at all; one under its rate at once."""
    feed = Feed(spark, tmp_path, "preview int, kind string, updated long, pps double, expected_pps double")
    q = feed.start(keyed.live_previews(feed.stream()), "previews", processingTime="300 milliseconds")
    feed.put([(1, "waveform", 1, 480e3, 480e3), (2, "waveform", 1, 480e3, 480e3), (2, "waveform", 2, 100e3, 480e3), (3, "spectrum", 1, 0.0, 480e3)])
    events = lambda: sorted(map(tuple, spark.table("previews").collect()))
    first = [(1, "shown", ""), (2, "cleared", "rate"), (3, "shown", "")]
    soon(lambda: len(events()) >= 5)
    q.stop()
    assert events() == sorted([*first, (1, "cleared", "silence"), (3, "cleared", "silence")])


def test_configuration_stream(spark, tmp_path):
    """Each packet under the settings in force; generations as of the table's patches."""
    schema = "board int, e long, is_patch boolean, points long, view string"
    feed = Feed(spark, tmp_path, schema)
    rows = [(b, e, (e + b) % 4 == 0, e if e % 8 < 5 else None, f"v{e % 3}" if e % 3 else None) for b in (1, 2) for e in range(40)]
    for lo in range(0, 40, 20):
        feed.put([r for r in rows if lo <= r[1] < lo + 20])
        time.sleep(1.1)
    q = feed.start(keyed.configured(feed.stream(), "board", "e", {"points": 512, "view": "dual"}), "settings")
    q.awaitTermination(120)
    want = set()
    for b in (1, 2):
        s = {"generation": 1, "packets": 0, "points": 512, "view": "dual"}
        for _, e, patch, points, view in [r for r in rows if r[0] == b]:
            if patch:
                s = {"generation": s["generation"] + 1, "packets": 0, "points": s["points"] if points is None else points, "view": view or s["view"]}
            else:
                s["packets"] += 1
                want.add((b, e, *s.values()))
    assert {tuple(r) for r in spark.table("settings").collect()} == want
    from fluxframe.operators.analysis import patched

    df = spark.createDataFrame(rows, schema)
    config = spark.createDataFrame([(b, 1, 512, "dual") for b in (1, 2)], "board int, generation long, points long, view string")
    table = {r.board: (r.generation, r.points, r.view) for r in patched(config, df.filter("is_patch"), "board", "e", ["points", "view"]).collect()}
    last = {b: max((e, g, p, v) for c, e, g, _, p, v in want if c == b)[1:] for b in (1, 2)}
    ends_with_patch = {b: (39 + b) % 4 == 0 for b in (1, 2)}
    assert all(table[b] == last[b] for b in (1, 2) if not ends_with_patch[b]) and not all(ends_with_patch.values())


def test_assembled_takes_any_number_of_groups(spark):
    """Groups are dealt by group, not by board or layout."""
    df = spark.range(64_000).select(F.lit(1).alias("board_id"), F.col("id").alias("e"), F.col("id").alias("frame_id"), (F.col("id") % 64).cast("int").alias("block_index"), F.lit(64).alias("block_count"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in keyed.assembled(df, ["board_id"], "e").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 500
