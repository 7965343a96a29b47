"""Stateful operators on streams whose state is kept by parts, and that act when nothing comes.

Reordering holds each packet that waits over a batch under its own number in the state store, so that a batch reads and writes
what moves and no more.
Spectra are assembled by frame group, so a board's groups are many tasks, and a timer gives groups up that never become whole.
A timer clears previews that stay silent. Patches of a configuration run in one stream with the packets that they apply to.
All need the RocksDB state store; orders are of arrival, and rows of one batch are taken in order of a column.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluxframe.streaming.receiver import MOST_DROPS, U32, WINDOW, Reorder, before


def _in_order(rows: Iterator[pd.DataFrame], order: str) -> list[dict]:
    return pd.concat(list(rows)).sort_values(order).to_dict("records")


class Held:
    """Packets by place: those of batches before in a map state, this batch's in memory until flush(). runs are the places held,
    as first and last of each stretch, in order, so that the nearest one is known without looking through the state."""

    def __init__(self, packets, runs: list[list[int]]) -> None:
        self.packets, self.runs, self.fresh = packets, runs, {}

    def add(self, place: int, p: dict) -> None:
        k = bisect.bisect_right(self.runs, [place, 1 << 65]) - 1
        if k >= 0 and place <= self.runs[k][1]:
            return
        self.fresh[place] = p
        before_, after = k >= 0 and self.runs[k][1] == place - 1, k + 1 < len(self.runs) and self.runs[k + 1][0] == place + 1
        if before_ and after:
            self.runs[k][1] = self.runs.pop(k + 1)[1]
        elif before_:
            self.runs[k][1] = place
        elif after:
            self.runs[k + 1][0] = place
        else:
            self.runs.insert(k + 1, [place, place])

    def pop(self) -> dict:
        """The nearest packet."""
        first = self.runs[0]
        place, first[0] = first[0], first[0] + 1
        if first[0] > first[1]:
            self.runs.pop(0)
        if place in self.fresh:
            return self.fresh.pop(place)
        (kept,) = self.packets.getValue((place,))
        self.packets.removeKey((place,))
        return json.loads(kept)

    def flush(self) -> None:
        for place, p in self.fresh.items():
            self.packets.updateValue((place,), (json.dumps(p, default=int),))


class _Reordering(StatefulProcessor):
    def __init__(self, window: int, mhz: int | None, order: str) -> None:
        self.window, self.mhz, self.order = window, mhz, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.packets = handle.getMapState("packets", "place long", "packet string")
        self.small = handle.getValueState("counts", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.small.get()[0]) if self.small.exists() else {"machine": None, "runs": []}
        machine = Reorder(self.window, self.mhz, kept["machine"])
        held = Held(self.packets, kept["runs"])
        s = machine.s
        for p in _in_order(rows, self.order):
            if s["expected"] is None:
                s["expected"] = p["seq_no"]
            elif before(p["seq_no"], s["expected"] % U32):
                s["late"] += 1
                continue
            held.add(s["expected"] + (p["seq_no"] - s["expected"]) % U32, p)
            while held.runs:
                distance = held.runs[0][0] - s["expected"]
                if distance == 0:
                    machine._accept(held.pop())
                    s["expected"] += 1
                elif distance <= self.window:
                    break
                else:
                    s["seq_gaps"] += 1
                    s["app_drops"] += min(distance, MOST_DROPS)
                    s["expected"] += distance
        held.flush()
        self.small.update((json.dumps({"machine": s, "runs": held.runs}, default=int),))
        yield pd.DataFrame([{"key": key[0], **machine.summary()}])

    def close(self) -> None:
        pass


REORDERED = "key int, released long, late long, seq_gaps long, frame_gaps long, sample0_gaps long, app_drops long, last_seq long, detected_mhz int"


def reordered(stream: DataFrame, key: str, order: str, window: int = WINDOW, mhz: int | None = None) -> DataFrame:
    """Reorder over a stream (key int, order, seq_no, frame_id, sample0, time_count), its summary after each batch."""
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=_Reordering(window, mhz, order), outputStructType=REORDERED, outputMode="update", timeMode="None")


GROUP = ["frame_group", "block_count"]


def assembled(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row for each frame group of a table of blocks (keys, order, frame_id, block_index, block_count): coverage, masks, whether
    it is complete and, if so, the frame with which it became so. Blocks beyond the count are refused. Two aggregations by group
    and block: a group is no task of its own."""
    taken = blocks.filter((F.col("block_index") >= 0) & (F.col("block_index") < F.least(F.lit(128), F.greatest("block_count", F.lit(1)))))
    taken = taken.withColumn("frame_group", F.call_function("div", F.col("frame_id"), F.greatest("block_count", F.lit(1))))
    first = taken.groupBy(*keys, *GROUP, "block_index").agg(F.min(F.struct(order, "frame_id")).alias("_first"))
    bit = lambda lo: F.coalesce(F.bit_or(F.when(F.col("block_index").between(lo, lo + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block_index") - lo))), F.lit(0).cast("long"))
    out = first.groupBy(*keys, *GROUP).agg(F.count("*").cast("int").alias("coverage"), bit(0).alias("mask_lo"), bit(64).alias("mask_hi"), F.max("_first").frame_id.alias("_frame"))
    complete = F.col("coverage") >= F.greatest("block_count", F.lit(1))
    return out.select(*keys, *GROUP, F.when(complete, F.col("_frame")).alias("frame_id"), "coverage", "mask_lo", "mask_hi", complete.alias("complete"))


class _Assembling(StatefulProcessor):
    def __init__(self, names: list[str], order: str, patience_ms: int) -> None:
        self.names, self.order, self.patience = names, order, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "mask string, published boolean")

    def _row(self, key: tuple, mask: int, frame: int | None, complete: bool) -> pd.DataFrame:
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        row = dict(zip(self.names, key, strict=True)) | {"frame_id": frame, "coverage": mask.bit_count(), "mask_lo": signed(mask & (1 << 64) - 1), "mask_hi": signed(mask >> 64), "complete": complete}
        return pd.DataFrame([row]).astype({"frame_id": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks = max(1, int(key[-1]))
        if self.group.exists():
            text, published = self.group.get()
            mask = int(text)
        else:
            mask, published = 0, False
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        for p in _in_order(rows, self.order):
            mask |= 1 << int(p["block_index"])
            if not published and mask.bit_count() >= blocks:
                published = True
                yield self._row(key, mask, int(p["frame_id"]), True)
        self.group.update((str(mask), published))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, published = self.group.get()
        self.group.clear()
        if not published:
            yield self._row(key, int(text), None, False)

    def close(self) -> None:
        pass


def assembled_stream(stream: DataFrame, keys: list[str], order: str, patience_s: float = 10) -> DataFrame:
    """The same over a stream: a group is given out once, when it becomes whole; patience_s after its first block its state goes,
    and one that isn't whole by then is given out as given up (complete false, no frame_id). Blocks of a whole group that come
    within that time are taken for repeats, later ones open a group anew."""
    taken = stream.filter((F.col("block_index") >= 0) & (F.col("block_index") < F.least(F.lit(128), F.greatest("block_count", F.lit(1)))))
    taken = taken.withColumn("frame_group", F.call_function("div", F.col("frame_id"), F.greatest("block_count", F.lit(1))))
    names = [*keys, *GROUP]
    types = dict(taken.dtypes)
    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "frame_id long, coverage int, mask_lo long, mask_hi long, complete boolean"])
    return taken.groupBy(*names).transformWithStateInPandas(statefulProcessor=_Assembling(names, order, int(patience_s * 1000)), outputStructType=schema, outputMode="append", timeMode="ProcessingTime")


class _Previews(StatefulProcessor):
    def __init__(self, silence_ms: int, least_pps: float, share: float) -> None:
        self.silence, self.least, self.share = silence_ms, least_pps, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("updated").iloc[-1]
        if self.shown.exists():
            self.handle.deleteTimer(self.shown.get()[0])
            self.shown.clear()
        if last["kind"] == "waveform" and last["pps"] < max(last["expected_pps"] * self.share, self.least):
            yield pd.DataFrame([{"preview": key[0], "event": "cleared", "reason": "rate"}])
            return
        expires = timerValues.getCurrentProcessingTimeInMs() + self.silence
        self.handle.registerTimer(expires)
        self.shown.update((expires,))
        yield pd.DataFrame([{"preview": key[0], "event": "shown", "reason": ""}])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.shown.clear()
        yield pd.DataFrame([{"preview": key[0], "event": "cleared", "reason": "silence"}])

    def close(self) -> None:
        pass


def live_previews(stream: DataFrame, seconds: float = 2, least_pps: float = 10_000, share: float = 0.25) -> DataFrame:
    """preview, event (shown or cleared) and reason of a stream of updates (preview int, kind, updated, pps, expected_pps): a
    waveform whose rate is under the larger of a share of the expected one and least_pps is cleared at once, any preview after
    so many seconds of silence, by a timer, whether or not others are updated."""
    return stream.groupBy("preview").transformWithStateInPandas(statefulProcessor=_Previews(int(seconds * 1000), least_pps, share), outputStructType="preview int, event string, reason string", outputMode="append", timeMode="ProcessingTime")


class _Configured(StatefulProcessor):
    def __init__(self, start: dict, order: str) -> None:
        self.start, self.order = start, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("configuration", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.now.get()[0]) if self.now.exists() else {"generation": 1, "packets": 0, **self.start}
        out = []
        for r in _in_order(rows, self.order):
            if r["is_patch"]:
                s |= {f: type(self.start[f])(v) for f, v in r.items() if f in self.start and not pd.isna(v)}
                s.update(generation=s["generation"] + 1, packets=0)  # what was gathered under the old one goes
            else:
                s["packets"] += 1
                out.append({"key": key[0], self.order: r[self.order], **s})
        self.now.update((json.dumps(s, default=int),))
        if out:
            yield pd.DataFrame(out)[["key", self.order, "generation", "packets", *self.start]]

    def close(self) -> None:
        pass


def configured(stream: DataFrame, key: str, order: str, start: dict) -> DataFrame:
    """Packets and patches of one stream (key, order, is_patch, and a column for each setting of start, null: as it was): each
    packet with the settings, the generation they are of, and how many packets that generation has seen, itself included. A
    patch begins a generation, and what was gathered under the one before goes."""
    types = dict(stream.dtypes)
    fields = ", ".join(f"{f} {types[f]}" for f in start)
    schema = f"key {types[key]}, {order} {types[order]}, generation long, packets long, {fields}"
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=_Configured(start, order), outputStructType=schema, outputMode="append", timeMode="None")
