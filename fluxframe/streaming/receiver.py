"""The stateful parts of the receiver on Structured Streaming: reordering, continuity, assembly of spectra, deduplication,
display capture, staleness, rates.

Each operator is a small state machine on plain dicts, which a stateful processor runs per flow with its state in the state
store; the same machine runs over a table in batch, so both can be compared.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

U32 = 1 << 32
WINDOW, MOST_DROPS = 8192, 1_000_000


def before(a: int, b: int) -> bool:
    """Whether sequence number a is older than b on the circle of 2 ** 32."""
    return (a - b) % U32 >= U32 // 2 and a != b


class Reorder:
    """Releases packets in order of sequence number. Older ones than expected are dropped (late), the first of equal ones
    stays, and if the nearest one held is further than `window`, the gap is counted and skipped; a hole within the window
    is waited for. Among released packets frame and sample gaps are counted, and the bandwidth is inferred from the distance
    of samples. Numbers are held unwrapped, so that the nearest one is the top of a heap."""

    FIELDS = ("released", "late", "seq_gaps", "frame_gaps", "sample0_gaps", "app_drops", "last_seq", "detected_mhz")

    def __init__(self, window: int = WINDOW, mhz: int | None = None, state: dict | None = None) -> None:
        self.window, self.mhz = window, mhz
        self.s = state or {"expected": None, "held": {}, "prev": None, **dict.fromkeys(self.FIELDS[:6], 0), "last_seq": None, "detected_mhz": None}
        self.nearest = sorted(map(int, self.s["held"]))

    def feed(self, p: dict) -> list[dict]:
        s, out = self.s, []
        if s["expected"] is None:
            s["expected"] = p["seq_no"]
        elif before(p["seq_no"], s["expected"] % U32):
            s["late"] += 1
            return out
        place = s["expected"] + (p["seq_no"] - s["expected"]) % U32
        if str(place) not in s["held"]:
            s["held"][str(place)] = p
            heapq.heappush(self.nearest, place)
        while self.nearest:
            distance = self.nearest[0] - s["expected"]
            if distance == 0:
                got = s["held"].pop(str(heapq.heappop(self.nearest)))
                self._accept(got)
                out.append(got)
                s["expected"] += 1
                continue
            if distance <= self.window:
                break
            s["seq_gaps"] += 1
            s["app_drops"] += min(distance, MOST_DROPS)
            s["expected"] += distance
        return out

    def _accept(self, p: dict) -> None:
        s, prev = self.s, self.s["prev"]
        s["released"] += 1
        s["last_seq"] = p["seq_no"]
        if prev:
            moved, beat = p["sample0"] - prev["sample0"], p["time_count"] * 4
            found = {1: 200, 2: 100, 8: 20}.get(moved // beat) if beat and moved % beat == 0 else None
            s["frame_gaps"] += p["frame_id"] - prev["frame_id"] != 1
            decimation = {200: 1, 100: 2, 20: 8}[self.mhz] if self.mhz else None
            s["sample0_gaps"] += (moved != beat * decimation) if decimation else found is None
            s["detected_mhz"] = found or s["detected_mhz"]
        s["prev"] = p

    def summary(self) -> dict:
        return {k: self.s[k] for k in self.FIELDS}


def signed(mask: int) -> int:
    """64 bits as the bit pattern of a long."""
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


class Assembler:
    """Whole spectra from blocks of up to 128 a frame group. Another group or layout (product, channels, blocks, taps) starts
    afresh; a block marks its place in a mask and, if it carries lanes, is written to its channels (chan0 on) of each lane. A
    group is given out when its mask becomes full, and again at a later block once `interval` ms have passed."""

    LAYOUT = ("product_id", "nchan", "block_count", "pfb_taps")
    EMPTY = {"amplitude": 0.0, "phase_rad": 0.0, "power_db": -160.0}

    def __init__(self, interval: float = float("inf"), state: dict | None = None) -> None:
        self.interval = interval
        self.s = state or {"group": None, "mask": 0, "complete": False, "sent": None, "lanes": {}, "published": 0, "dropped": 0, "refused": 0}

    def feed(self, p: dict) -> list[dict]:
        s, blocks, now = self.s, max(1, p["block_count"]), p.get("t_ms") or 0
        if p["block_index"] >= min(128, blocks):
            s["refused"] += 1
            return []
        key = [p["frame_id"] // blocks, *(p.get(c) for c in self.LAYOUT)]
        if s["group"] != key:
            s["dropped"] += s["group"] is not None and not s["complete"]
            s.update(group=key, mask=0, complete=False, lanes={})
        s["mask"] |= 1 << p["block_index"]
        for lane in p.get("lanes") or []:
            kept = s["lanes"].setdefault(str(lane["input"]), {c: [v] * p["nchan"] for c, v in self.EMPTY.items()})
            for c in self.EMPTY:
                end = min(p["nchan"], p["chan0"] + p["chan_count"], p["chan0"] + min(len(lane[x]) for x in self.EMPTY))
                kept[c][p["chan0"] : end] = [float(v) for v in lane[c][: max(0, end - p["chan0"])]]
        was, s["complete"] = s["complete"], s["mask"].bit_count() >= blocks
        if not s["complete"] or was and now - s["sent"] < max(self.interval, 1):
            return []
        s["sent"] = now
        s["published"] += 1
        out = {"frame_group": key[0], "frame_id": p["frame_id"], "coverage": s["mask"].bit_count(), "mask_lo": signed(s["mask"]), "mask_hi": signed(s["mask"] >> 64)}
        return [out | ({"lanes": s["lanes"]} if s["lanes"] else {})]

    def summary(self) -> dict:
        return {k: self.s[k] for k in ("published", "dropped", "refused")}


class Capture:
    """A display's packets: it starts at the first one's number and keeps all that are not before it. Once the `needed` ones,
    every `stride`-th by number, are there, or `hold` are kept at all, those up to the first hole are given out, and it
    starts again with the next packet."""

    def __init__(self, needed: int, stride: int = 1, hold: int = 256, state: dict | None = None) -> None:
        self.needed, self.stride, self.hold = needed, max(1, stride), hold
        self.s = state or {"start": None, "seqs": []}
        self.kept = set(self.s["seqs"])

    def feed(self, p: dict) -> list[dict]:
        s = self.s
        if s["start"] is None:
            s["start"] = p["seq_no"]
        if before(p["seq_no"], s["start"]):
            return []
        if p["seq_no"] not in self.kept:
            self.kept.add(p["seq_no"])
            s["seqs"].append(p["seq_no"])
        got = next((k for k in range(self.needed) if (s["start"] + k * self.stride) % U32 not in self.kept), self.needed)
        if got < self.needed and len(self.kept) < self.hold:
            return []
        out = [{"first": s["start"], "last": (s["start"] + (got - 1) * self.stride) % U32, "packets": got}]
        s.update(start=None, seqs=[])
        self.kept = set()
        return out


class PreviewGate:
    """Which blocks are decoded for a preview. The first packet chooses the frame group `lead` ahead; of that group each block
    is taken once. A packet of a later group chooses anew once `interval` ms have passed since the last choice and, if a block
    was taken, `timeout` ms since the first one was."""

    def __init__(self, lead: int = 4096, interval: float = 1, timeout: float = 500, state: dict | None = None) -> None:
        self.lead, self.interval, self.timeout = lead, max(1, interval), timeout
        self.s = state or {"group": None, "blocks": 0, "mask": 0, "armed": 0, "hit": None}

    def feed(self, p: dict) -> list[dict]:
        s, blocks, now = self.s, min(128, max(1, p["block_count"])), p["t_ms"]
        if p["block_index"] >= blocks:
            return []
        group = p["frame_id"] // blocks
        if s["group"] is None or group > s["group"]:
            wait = s["group"] is not None and (now - s["armed"] < self.interval or s["hit"] is not None and now - s["hit"] < self.timeout)
            if not wait:
                s.update(group=group + self.lead, blocks=blocks, mask=0, armed=now, hit=None)
            return []
        bit = 1 << p["block_index"]
        if group < s["group"] or s["blocks"] != blocks or s["mask"] & bit:
            return []
        s["mask"] |= bit
        s["hit"] = now if s["hit"] is None else s["hit"]
        return [{"frame_group": group, "block_index": p["block_index"], "seq_no": p["seq_no"]}]


class Arbiter:
    """One link for packets of several streams, by strict priority (0 first): a packet that has begun keeps the link for its
    beats; whenever the link is free, the waiting packet of least priority number, and of these the first, begins. Packets are
    fed in order of arrival; those still waiting at the end are sent by finish()."""

    def __init__(self, state: dict | None = None) -> None:
        self.s = state or {"free": 0, "waiting": []}

    def _sent(self, until: float) -> list[dict]:
        s, out = self.s, []
        while s["waiting"]:
            start = max(s["free"], min(w[1] for w in s["waiting"]))
            if start >= until:
                break
            best = min(w for w in s["waiting"] if w[1] <= start)
            s["waiting"].remove(best)
            out.append({"id": best[2], "priority": best[0], "start": start})
            s["free"] = start + best[3]
        return out

    def feed(self, p: dict) -> list[dict]:
        out = self._sent(p["arrival"])
        self.s["waiting"].append([p["priority"], p["arrival"], p["id"], p["beats"]])
        return out

    def finish(self) -> list[dict]:
        return self._sent(float("inf"))


class Ring:
    """A buffer of whole frames in front of a slower reader: a frame that finds it full is dropped whole. Events are frames
    (write true) and reads; each frame tells whether it was kept, with the level after it."""

    def __init__(self, frames: int, state: dict | None = None) -> None:
        self.frames = frames
        self.s = state or {"level": 0, "high_water": 0, "kept": 0, "dropped": 0}

    def feed(self, p: dict) -> list[dict]:
        s = self.s
        if not p["write"]:
            s["level"] = max(0, s["level"] - 1)
            return []
        kept = s["level"] < self.frames
        s["level"] += kept
        s["kept"] += kept
        s["dropped"] += not kept
        s["high_water"] = max(s["high_water"], s["level"])
        return []

    def summary(self) -> dict:
        return {k: self.s[k] for k in ("kept", "dropped", "high_water")}


class Steps:
    """A machine of a pure step function: the state after each event."""

    def __init__(self, start, step: Callable, order: str, state: dict | None = None) -> None:
        self.step, self.order = step, order
        self.s = state or {"now": start}

    def feed(self, e: dict) -> list[dict]:
        now = self.s["now"] = self.step(self.s["now"], e)
        told = now if isinstance(now, dict) else {"state": now, "error": 0}
        return [{self.order: e[self.order], "state": told["state"], "error": told["error"]}]


class _Machine(StatefulProcessor):
    """Runs a machine for each key, in order of arrival, its state as JSON in the state store."""

    def __init__(self, make: Callable[[dict | None], object], order: str, columns: list[str], summary: bool) -> None:
        self.make, self.order, self.columns, self.summary = make, order, columns, summary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else None
        machine = self.make(kept)
        out: list[dict] = []
        for p in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            out += machine.feed(p)
        self.state.update((json.dumps(machine.s, default=int),))
        if self.summary:
            out = [machine.summary()]
        if out:
            yield pd.DataFrame([{"key": key[0], **r} for r in out])[["key", *self.columns]]

    def close(self) -> None:
        pass


def run_stream(df: DataFrame, key: str, order: str, make: Callable[[dict | None], object], schema: str, summary: bool = False) -> DataFrame:
    """A machine over a stream; needs the RocksDB state store. schema's first column is named key."""
    columns = [c.strip().split()[0] for c in schema.split(",")][1:]
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=_Machine(make, order, columns, summary), outputStructType=schema, outputMode="update" if summary else "append", timeMode="None")


def run_batch(df: DataFrame, key: str, order: str, make: Callable[[dict | None], object], schema: str, summary: bool = False) -> DataFrame:
    """The same machine over a table: rows come sorted by key and order, in batches, and a machine is carried from batch to
    batch until its key ends, so memory holds a batch and one state, however long a flow."""
    out_schema = T._parse_datatype_string(schema)
    columns = [f.name for f in out_schema.fields][1:]
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, out = None, None, []

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": r["key"], **{c: r.get(c) for c in columns}} for r in rows], schema=arrow)

        def ended(machine, now) -> list[dict]:
            last = [] if machine is None else [machine.summary()] if summary else getattr(machine, "finish", list)()
            return [{"key": now, **r} for r in last]

        for batch in batches:
            for p in batch.to_pylist():
                if machine is None or p[key] != now:
                    out += ended(machine, now)
                    machine, now = make(None), p[key]
                got = machine.feed(p)
                if not summary:
                    out += [{"key": now, **r} for r in got]
            if out:
                yield batch_of(out)
                out = []
        if out := ended(machine, now):
            yield batch_of(out)

    return df.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, out_schema)


def windowed_rates(df: DataFrame, seconds: int, watermark: str = "10 seconds") -> DataFrame:
    """Packets and bytes of windows of event time."""
    w = df.withWatermark("ts", watermark).groupBy(F.window("ts", f"{seconds} seconds"), "flow_id").agg(F.count("*").alias("packets"), F.sum("udp_payload_len").alias("bytes"))
    return w.select(F.col("window.start").alias("start"), "flow_id", "packets", (F.col("packets") / seconds).alias("pps"), (F.col("bytes") * 8 / seconds / 1e9).alias("gbps"))


def first_blocks(df: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """The first packet of each block, on a stream."""
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["frame_group", "block_index"])


def stale(df: DataFrame, now, seconds: float = 2, least_pps: float = 10_000, share: float = 0.25) -> DataFrame:
    """Previews to clear: updated over `seconds` ago, or of a waveform whose rate is under the larger of a share of the
    expected one and least_pps."""
    old = F.unix_timestamp(now) - F.unix_timestamp("updated") > seconds
    slow = (F.col("kind") == "waveform") & (F.col("pps") < F.greatest(F.col("expected_pps") * share, F.lit(least_pps)))
    return df.filter(old | slow)
