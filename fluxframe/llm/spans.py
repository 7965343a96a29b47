"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after a run of . ! ? that white space follows, after a newline, and, so that a text without
such signs has spans too, in stretches of more than LONG words without an end after the word of least hash of each WINDOW
words (the last of equals, so that a run of one word is cut as well). Cuts more than LONG words inside a passage depend on it
alone, and sentences have at most LONG words: any passage of 2 * LONG + MIN_WORDS words, wherever it starts, holds a span. From
every sentence on, and up to every sentence, a span takes the fewest consecutive sentences (LEAST at least) that have
MIN_WORDS words or more, so that a passage's spans reach both its ends. A span's hash covers its words, lower-cased and apart
from the white space between them. Spans of one hash are one passage: the first by (doc_id, row's hash, place) stays, and
every sentence that any other covers is removed.

Within a slice of rows on a worker all but the first of each hash are marked at once; only firsts of slices are exchanged,
so a passage of a third of all rows sends a row for each slice.

Defined results: null texts stay null and empty ones empty; very long texts are taken whole, one at a time; rows that are
equal in doc_id and text count as one document, and all keep or lose the same sentences; equal texts under several ids are
one passage after another; a null doc_id orders before all others; a text whose sentences all go becomes empty; an empty
table gives no rows; all columns stay, but that n_sentences and removed of a report replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxframe.llm.arrays import LOWER, RangeHash, slices, text_bytes, words
from fluxframe.llm.tables import at, fresh, keep, spread_join, table, without

LEAST, MIN_WORDS = 2, 20
LONG, WINDOW = 15, 8
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


class Sentences:
    """The sentences of all rows of a slice: first word, row, and the spans that start there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        start, end, row = words(data, offsets)
        n = len(start)
        self.hashes = RangeHash(LOWER[data])(start, end)
        last = np.append(row[1:] != row[:-1], True) if n else np.zeros(0, bool)
        lines = np.append(0, np.cumsum(data == 0x0A))
        newline = np.append(lines[start[1:]] > lines[end[:-1]], True) if n else last
        ends = last | newline | (_ENDS[data[end - 1]] if n else last)
        # In a stretch of more than LONG words without an end, cuts depend on words alone.
        stop = np.flatnonzero(ends)
        sizes = np.diff(np.append(-1, stop))
        if (sizes > LONG).any():
            left = np.repeat(stop, sizes) - np.arange(n)
            inside = np.flatnonzero((np.repeat(sizes, sizes) > LONG) & (left >= WINDOW - 1))  # starts of whole windows
            least = np.lib.stride_tricks.sliding_window_view(self.hashes, WINDOW)[inside, ::-1].argmin(1)
            ends[inside + WINDOW - 1 - least] = True
        self.last = np.flatnonzero(ends)
        self.first = np.append(0, self.last[:-1] + 1) if n else self.last
        self.row = row[self.first] if n else self.last
        self.begin, self.limits = (start[self.first] if n else self.first), np.searchsorted(self.row, np.arange(len(offsets)))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, number of sentences and hash of each span."""
        count = len(self.first)
        all_ = np.arange(count)
        to = np.maximum(np.searchsorted(self.last, self.first + MIN_WORDS - 1), all_ + LEAST - 1)
        ok = (to < count) & (to < self.limits[self.row + 1])
        since = np.minimum(np.searchsorted(self.first, self.last - MIN_WORDS + 1, side="right") - 1, all_ - LEAST + 1)
        back = since >= self.limits[self.row]
        both = np.unique(np.concatenate([all_[ok] * count + to[ok], since[back] * count + all_[back]]))
        i, to = both // max(count, 1), both % max(count, 1)
        return i, to - i + 1, RangeHash(self.hashes)(self.first[i], self.last[to] + 1)


MARKS = "h long, doc_id long, rk long, s int, n int, first boolean"


def occurrences(docs: DataFrame) -> DataFrame:
    """Spans of docs (doc_id, rk, text): hash, document, first sentence, sentences; first is false if the slice has an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = Sentences(*text_bytes(batch.column("text")))
            i, n, h = found.spans()
            row = found.row[i]
            doc = batch.column("doc_id")
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
            null = doc.is_null().to_numpy(zero_copy_only=False)[row]
            rk = batch.column("rk").to_numpy(zero_copy_only=False)[row]
            s = (i - found.limits[row]).astype(np.int32)
            order = np.lexsort([s, rk, ids, ~null, h])
            new = np.append(True, h[order][1:] != h[order][:-1]) if len(order) else np.zeros(0, bool)
            # copies of one row in a slice are one document: their first spans are all first
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            same = (ids[order] == ids[lead]) & (null[order] == null[lead]) & (rk[order] == rk[lead]) & (s[order] == s[lead])
            take = new | ~same
            order, first = order[take], new[take]
            yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(ids[order], mask=null[order]), pa.array(rk[order]), pa.array(s[order]), pa.array(n[order].astype(np.int32)), pa.array(first)], names=["h", "doc_id", "rk", "s", "n", "first"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, MARKS)


def repeated(docs: DataFrame) -> DataFrame:
    """rk and spans (array of first sentence and count): what each document loses."""
    found = occurrences(docs)
    # Spans known not to be first are dealt by a key of their own, so that no passage comes together in one task.
    found = found.withColumn("deal", F.when(F.col("first"), F.col("h")).otherwise(F.xxhash64("h", "rk", "s")))
    place = F.dense_rank().over(Window.partitionBy("first", "deal").orderBy(F.col("doc_id").asc_nulls_first(), "rk", "s"))
    lost = found.withColumn("place", place).filter(~F.col("first") | (F.col("place") > 1))
    return lost.groupBy("rk").agg(F.collect_set(F.struct("s", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, report: bool = False) -> DataFrame:
    """docs with repeated spans removed from text. With report also n_sentences (int) and removed (array<int>, the places
    of the sentences that went)."""
    added = ["n_sentences", "removed"] if report else []
    given = without(docs, *added)
    rk, spans = fresh(docs.columns, "rk", "spans")
    mark = F.xxhash64(F.col("doc_id").cast("long"), "text")
    lost = repeated(docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("rk"), "text"))
    lost = at(docs.sparkSession, keep(lost, "repeated-spans"), lost).select(F.col("rk").alias(rk), F.col("spans").alias(spans))
    # Rows equal in doc_id and text can be many: the frequent ones are dealt over tasks by a random number, which decides nothing else.
    joined = spread_join(docs.select(*given).withColumn(rk, mark), lost, [rk], [F.rand(3)], "left").select(*given, spans)
    schema = T.StructType([*(docs.schema[c] for c in given), *([T.StructField("n_sentences", T.IntegerType()), T.StructField("removed", T.ArrayType(T.IntegerType()))] if report else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            data, offsets = text_bytes(batch.column("text"))
            found = Sentences(data, offsets) if report or batch.column(spans).null_count < batch.num_rows else None
            raw = memoryview(data)
            texts, gone = [], []
            lose = batch.column(spans).to_pylist()
            known = batch.column("text").is_valid().to_pylist()
            for k in range(batch.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if not lose[k]:
                    texts.append(bytes(raw[a:b]) if known[k] else None)
                    gone.append([])
                    continue
                lo, hi = found.limits[k], found.limits[k + 1]
                out = np.zeros(hi - lo, bool)
                for x in lose[k]:
                    out[x["s"] : x["s"] + x["n"]] = True
                begin = np.append(found.begin[lo:hi], b)
                begin[0] = a  # white space before the first sentence is its own
                texts.append(b"".join(raw[begin[i] : begin[i + 1]] for i in np.flatnonzero(~out)))
                gone.append(np.flatnonzero(out).tolist())
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in given]
            if report:
                columns += [pa.array(np.diff(found.limits).astype(np.int32)), pa.array(gone, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_sentences", F.size("removed").alias("n_removed"), "removed", "text")
