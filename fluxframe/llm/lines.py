"""Line dedup over levelled sorted runs of line hashes.

A text is split at \\n; a line's key is the line without white space at both ends, A-Z lower-cased, and stands as a hash of 128
bits. line_counts() counts, for each batch of documents, the documents that hold a key. Runs keeps such counts as sorted
runs: tables bucketed and sorted by hash in the shared folder. Each new batch is merge-anti-joined with the runs, so that keys
which a run has settled (`least` documents or more) are not added again, and what is left becomes a run of level 0. Two runs of
one level are compacted into one of the next. Runs lie in the same buckets, so that compaction and the anti-join shuffle no
run. drop_lines() then takes the lines of settled keys out of every document.

A frequent line costs little: slices of about a megabyte count their keys before the shuffle; the HOT keys of highest
counts are known to every task; only documents' other keys are joined with the settled ones, by hash.

Defined results: every row is a document, so copies of a row count as several; null and empty texts are one empty line, which
is never dropped, as keys of white space alone aren't; null texts become empty; a text whose lines all go becomes empty; very
long texts are taken whole, one at a time; rows of null doc_id are documents like others; an empty table gives no rows; all
columns stay, but that n_lines and n_dropped of a report replace columns of those names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxframe.llm.arrays import LOWER, SPACE, gathered, slices, text_bytes
from fluxframe.llm.tables import at, drop, fresh, keep, new_path, spread_join, table, without

#: A key in that many documents goes.
LEAST = 10
#: Batches that a table is taken in.
BATCHES = 6
#: Keys that every task knows: 16 bytes each.
HOT = 4096


class Lines:
    """The lines of all rows of a slice: start and end, the first line of each row, and the keys, each distinct key once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        ends = np.flatnonzero(data == 0x0A)
        per_row = np.bincount(np.searchsorted(offsets, ends, side="right") - 1, minlength=len(offsets) - 1) + 1
        self.limits = np.append(0, np.cumsum(per_row))
        self.start, self.end = np.empty((2, self.limits[-1]), np.int64)
        inner = np.ones(self.limits[-1], bool)
        inner[self.limits[:-1]] = False
        self.start[~inner], self.start[inner] = offsets[:-1], ends + 1
        self.end[np.append(inner[1:], False)], self.end[self.limits[1:] - 1] = ends, offsets[1:]
        self.row = np.repeat(np.arange(len(offsets) - 1), per_row)
        ink = np.flatnonzero(~SPACE[data])
        first, last = np.searchsorted(ink, self.start), np.searchsorted(ink, self.end)
        some = np.flatnonzero(last > first)
        keys = gathered(LOWER[data], ink[first[some]], ink[last[some] - 1] + 1).dictionary_encode()
        self.hashes = [hashlib.blake2b(k, digest_size=16).digest() for k in keys.dictionary.to_pylist()]
        self.code = np.full(len(self.start), -1)  # of a line's key; -1 for lines of white space
        self.code[some] = keys.indices.to_numpy()

    def in_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and code of each row's distinct keys."""
        n = max(len(self.hashes), 1)
        both = np.unique((self.row * n + self.code)[self.code >= 0])
        return both // n, both % n


def line_counts(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """batch, h and n: the rows of docs (text) that hold the key, by batches of input partitions."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() % batches
        for part in slices(found, "text"):
            lines = Lines(*text_bytes(part.column("text")))
            n = np.bincount(lines.in_rows()[1], minlength=len(lines.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch, np.int32)), pa.array(lines.hashes, pa.binary()), pa.array(n)], names=["batch", "h", "n"])

    return docs.select("text").mapInArrow(run, "batch int, h binary, n long").groupBy("batch", "h").agg(F.sum("n").alias("n"))


class Runs:
    """Sorted runs of (h, n) by level. n is how many documents were counted until the key was settled."""

    def __init__(self, spark: SparkSession, least: int = LEAST) -> None:
        self.spark, self.least = spark, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _gone(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop(self.spark, self.paths.pop(name))

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return a.hint("merge").join(b.withColumnRenamed("n", "m"), "h", "full_outer").select("h", n.alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Adds what a batch counted (h unique, n), but for keys that are settled."""
        new = counts.select("h", "n").repartition("h")
        for name in filter(None, self.levels):
            new = new.hint("merge").join(self.spark.table(name).filter(F.col("n") >= self.least), "h", "left_anti")
        run, level = self._write(new), 0
        while level < len(self.levels) and self.levels[level]:
            both = self.levels[level], run
            run = self._write(self._merged(*map(self.spark.table, both)))
            self.levels[level] = None
            for name in both:
                self._gone(name)
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def settled(self) -> DataFrame:
        """h of the keys in `least` documents or more."""
        runs = [self.spark.table(name) for name in filter(None, self.levels)]
        if not runs:
            return self.spark.createDataFrame([], "h binary")
        out = runs[0]
        for run in runs[1:]:
            out = self._merged(out, run)
        return out.filter(F.col("n") >= self.least).select("h")

    def close(self) -> None:
        for name in list(filter(None, self.levels)):
            self._gone(name)
        self.levels = []


def keys_of(docs: DataFrame, but: frozenset[bytes]) -> DataFrame:
    """rk and h of the keys of docs (rk, text), without those in but."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(found, "text"):
            lines = Lines(*text_bytes(part.column("text")))
            row, code = lines.in_rows()
            row = row[ok := ~np.array([h in but for h in lines.hashes], bool)[code]]
            yield pa.RecordBatch.from_arrays([part.column("rk").take(pa.array(row)), pa.array(lines.hashes, pa.binary()).take(pa.array(code[ok]))], names=["rk", "h"])

    return docs.select("rk", "text").mapInArrow(run, "rk long, h binary")


def drop_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, report: bool = False) -> DataFrame:
    """docs without the lines whose key `least` rows or more hold. With report also n_lines (before) and n_dropped (longs)."""
    spark = docs.sparkSession
    counts = line_counts(docs, batches)
    path = new_path(spark, "line-counts")
    counts.write.partitionBy("batch").parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    runs = Runs(spark, least)
    for (batch,) in sorted(counts.select("batch").distinct().collect()):
        runs.add(counts.filter(F.col("batch") == batch))
    settled = runs.settled()
    settled = at(spark, settled_path := keep(settled, "settled-lines"), settled)
    runs.close()
    # A key of n documents has at least n / batches of them in one batch, so the keys of highest counts are among these.
    top = counts.orderBy(F.desc("n")).limit(HOT).select("h").distinct()
    hot = frozenset(bytes(r.h) for r in top.join(settled, "h", "left_semi").collect())
    drop(spark, path)

    added = ["n_lines", "n_dropped"] if report else []
    given = without(docs, *added)
    rk, lost_ = fresh(docs.columns, "rk", "lost")
    mark = F.xxhash64(F.col("doc_id").cast("long"), "text")  # rows of one mark by chance lose each its own lines: all here are settled
    pairs = keys_of(docs.select(mark.alias("rk"), "text"), hot)
    lost = pairs.join(settled, "h", "left_semi").groupBy("rk").agg(F.collect_set("h").alias("lost"))
    lost = at(spark, keep(lost, "dropped-lines"), lost).select(F.col("rk").alias(rk), F.col("lost").alias(lost_))
    drop(spark, settled_path)
    joined = spread_join(docs.select(*given).withColumn(rk, mark), lost, [rk], [F.rand(3)], "left").select(*given, lost_)
    types = {"n_lines": T.LongType(), "n_dropped": T.LongType()}
    schema = T.StructType([*(docs.schema[c] for c in given), *(T.StructField(c, types[c]) for c in added)])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(found, "text", 1 << 19):
            data, offsets = text_bytes(batch.column("text"))
            lines = Lines(data, offsets)
            everywhere = np.array([h in hot for h in lines.hashes] + [False], bool)
            gone = everywhere[lines.code]
            code_of = {h: k for k, h in enumerate(lines.hashes)}
            for k, own in enumerate(batch.column(lost_).to_pylist()):
                if own:
                    a, b = lines.limits[k], lines.limits[k + 1]
                    gone[a:b] |= np.isin(lines.code[a:b], [code_of[bytes(h)] for h in own if bytes(h) in code_of])
            raw, texts = memoryview(data), []
            n_gone = np.add.reduceat(gone, lines.limits[:-1], dtype=np.int64)
            for k in range(batch.num_rows):
                if n_gone[k]:
                    stay = np.arange(lines.limits[k], lines.limits[k + 1])[~gone[lines.limits[k] : lines.limits[k + 1]]]
                    texts.append(b"\n".join(raw[lines.start[i] : lines.end[i]] for i in stay))
                else:
                    texts.append(bytes(raw[offsets[k] : offsets[k + 1]]))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in given]
            more = {"n_lines": np.diff(lines.limits), "n_dropped": n_gone}
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(more[c]) for c in added)], names=schema.names)

    return joined.mapInArrow(run, schema)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id
"""
