"""Exact top-k by inner product with a vector-approximation file.

1. Vectors of integers are dealt into blocks of a bounded number of rows by a hash of their id. A block of the file holds cells
   alone: each dimension is cut into 2 ** bits equal steps between the block's lowest and highest value, one byte a cell.
   Exact vectors stay apart, in a table by id.
2. Each block of queries meets each block of cells of the same dimension, in a task of the pair's own. There the cells give a
   lower and an upper bound of every score, a strip of queries at a time; a candidate whose upper bound is below the query's
   k-th best lower bound in the block is out.
3. Over all blocks, what is below a query's k-th best lower bound is out. Exact vectors are read by id in order of falling
   upper bound: first the FIRST * k highest of each query; then all whose upper bound reaches the k-th best exact score found
   so far, after which no bound is left that could matter, and the result is certain.

Every query is compared with every candidate's cells, in blocks, so the work grows as queries times candidates; memory is
that of two blocks and a strip, and no block is broadcast or collected.

Arithmetic is exact: sums are taken in a type that holds them, from 32-bit floats up to Python's integers. A component of which
64 * x, or a score which does not fit into 64 bits raises.

Defined results: a vector that is null or holds a null or a component that is not finite takes no part, nor does a row
without id or an empty vector; of rows with one id the least vector counts; vectors of different length are not compared;
equal scores go to the smaller id; fewer than k candidates give as many rows; vectors of any length take part, in as many cells; an
empty table gives no rows; columns other than vec_id and the vector are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxframe.llm.tables import at, drop, keep, spread_join, table

CANDIDATES, QUERIES, STRIP = 1 << 14, 1 << 11, 1 << 8
#: Exact vectors read for a query at first, in multiples of k.
FIRST = 2
BLOCK = "dim int, block int, ids binary, cells binary, low binary, step binary"


def exact_type(values: np.ndarray) -> np.dtype:
    """The smallest type that holds the values."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    return np.dtype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int64)


def _sums(dim: int, a: int, b: int) -> type:
    """A type in which sums of dim products of numbers up to a and b are exact."""
    most = dim * a * b
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def _most(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def _vectors(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Dimension, ids in ascending order, and vectors of a group of rows."""
    group = group.sort_by([("id", "ascending")]).combine_chunks()
    dim = group.column("dim")[0].as_py()
    vectors = group.column("vector").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    return dim, group.column("id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cells(rows: DataFrame, bits: int) -> DataFrame:
    """rows (id long, vector array<long>, dim, block) as blocks of cells."""

    def pack(group: pa.Table) -> pa.Table:
        dim, ids, exact = _vectors(group)
        low, high = exact.min(0), exact.max(0)
        # unsigned, so that the distance of two 64-bit numbers fits
        over = (high.view(np.uint64) - low.view(np.uint64)) >> np.uint64(bits)
        step = over + np.uint64(1)
        cell = ((exact.view(np.uint64) - low.view(np.uint64)) // step).astype(np.uint8)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": group.column("block").slice(0, 1).cast(pa.int32()), "ids": [ids.tobytes()], "cells": [cell.tobytes()], "low": [low.tobytes()], "step": [step.tobytes()]})

    return rows.groupBy("dim", "block").applyInArrow(pack, BLOCK)


def asked(rows: DataFrame) -> DataFrame:
    """Blocks of queries, with their exact vectors."""

    def pack(group: pa.Table) -> pa.Table:
        dim, ids, exact = _vectors(group)
        kind = exact_type(exact)
        return pa.table({"dim": pa.array([dim], pa.int32()), "with": group.column("block").slice(0, 1).cast(pa.int32()), "q_ids": [ids.tobytes()], "q_exact": [bytes([kind.itemsize]) + exact.astype(kind).tobytes()]})

    return rows.groupBy("dim", "block").applyInArrow(pack, "dim int, with int, q_ids binary, q_exact binary")


def search(vectors: DataFrame, is_query, k: int = 20, bits: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row of vectors (vec_id, vector array<long>) for which
    is_query holds, among all rows but its own."""
    if not 1 <= bits <= 8:
        raise ValueError("bits of a cell: 1 to 8")
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min("vector").alias("vector"))
    rows = rows.withColumn("dim", F.size("vector"))
    rows = at(spark, keep(rows, "va-exact"), rows)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q")).first()
    n_blocks, n_with = -(-max(sizes.n, 1) // CANDIDATES), -(-max(sizes.q, 1) // QUERIES)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    held = cells(rows.withColumn("block", block(n_blocks)), bits)
    held_path = keep(held, "va-cells")
    held = at(spark, held_path, held)
    ask = asked(rows.filter(is_query(F.col("id"))).withColumn("block", block(n_with)))
    ask_path = keep(ask, "va-queries")
    ask = at(spark, ask_path, ask)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = held.withColumn("with", every(n_with)).hint("merge").join(ask.withColumn("block", every(n_blocks)), ["dim", "block", "with"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("dim", "ids", "cells", "low", "step", "q_ids", "q_exact")}
                for q, ids, low, high in bounds_of_block(one, k):
                    yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": ids, "low": low, "high": high})

    found = met.mapInArrow(scan, "query_id long, vec_id long, low long, high long")
    found_path = keep(found, "va-bounds")
    found = at(spark, found_path, found)
    drop(spark, held_path)
    drop(spark, ask_path)
    kth = lambda df, by: top(df, by, k).filter(F.col("place") == k).select("query_id", F.col(by).alias("least"))
    may = found.join(kth(found, "low"), "query_id", "left").filter(F.coalesce(F.col("high") >= F.col("least"), F.lit(True))).drop("least")
    placed = may.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")))
    placed = at(spark, keep(placed, "va-candidates"), placed)
    drop(spark, found_path)
    first = scores(placed.filter(F.col("place") <= FIRST * k), rows)
    first = at(spark, keep(first, "va-scores"), first)
    more = placed.filter(F.col("place") > FIRST * k).join(kth(first, "score"), "query_id").filter(F.col("high") >= F.col("least"))
    more = at(spark, keep(more, "va-more"), more)
    return top(first.union(scores(more, rows)), "score", k).select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each query_id that are highest by a column, ties to the smaller vec_id, with their place."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, vec_id and score of pairs (a written table), from exact vectors fetched by id. A vector that is a candidate of
    most queries, or a query of most candidates, is dealt over tasks."""
    pairs = pairs.select("query_id", "vec_id")
    both = spread_join(pairs, rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("x")), ["vec_id"], ["query_id"])
    both = spread_join(both, rows.select(F.col("id").alias("query_id"), F.col("vector").alias("y")), ["query_id"], ["vec_id"], counted=pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "xy")
            kind = _sums(int(sizes.max(initial=0)), _most(x), _most(y))
            products = x.astype(kind) * y.astype(kind)
            out = np.add.reduceat(products, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
            if kind is object and any(not -(1 << 63) <= v < 1 << 63 for v in out):
                raise OverflowError("a score does not fit into 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(out.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return both.select("query_id", "vec_id", "x", "y").mapInArrow(run, "query_id long, vec_id long, score long")


def bounds_of_block(one: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For strips of one block of queries, what one block of cells can't rule out: query ids, candidate ids and bounds."""
    dim = one["dim"]
    ids, q_ids = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["q_ids"], np.int64)
    cell = np.frombuffer(one["cells"], np.uint8).reshape(-1, dim)
    low, step = np.frombuffer(one["low"], np.int64), np.frombuffer(one["step"], np.uint64)
    asked_ = np.frombuffer(one["q_exact"], np.dtype(f"i{one['q_exact'][0]}"), offset=1).reshape(-1, dim)
    wide = max(_most(low), *(int(a) + 256 * int(b) for a, b in zip(np.abs(low.astype(object)), step.tolist(), strict=True)))
    kind = _sums(dim, wide, _most(asked_))
    floor = low.astype(kind) + cell.astype(kind) * step.astype(kind)
    ceiling = floor + (step.astype(kind) - 1)
    least = kind(-np.inf) if kind in (np.float32, np.float64) else np.iinfo(np.int64).min
    n = len(ids)
    for lo in range(0, len(q_ids), STRIP):
        q = q_ids[lo : lo + STRIP]
        x = asked_[lo : lo + STRIP].astype(kind)
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        upper = up @ ceiling.T + down @ floor.T
        lower = up @ floor.T + down @ ceiling.T
        own = np.searchsorted(ids, q)
        has = np.flatnonzero((own < n) & (ids[np.minimum(own, n - 1)] == q))
        if kind is object:  # a score that matters fits into 64 bits
            upper, lower = (np.clip(b, -(1 << 63), (1 << 63) - 1) for b in (upper, lower))
        lower[has, own[has]] = least
        limit = (np.sort if kind is object else lambda a, axis: np.partition(a, n - k, axis=axis))(lower, axis=1)[:, n - k] if n > k else np.full(len(q), least, kind)
        may = upper >= limit[:, None]
        may[has, own[has]] = False
        a, b = np.nonzero(may)
        yield q[a], ids[b], lower[a, b].astype(np.int64), upper[a, b].astype(np.int64)


def whole_numbers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and vector: floor(scale * x) of each component; null if the vector can't take part. Raises where that does not
    fit into 64 bits."""
    x = F.col("embedding").cast(T.ArrayType(T.DoubleType()))
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    fits: Column = F.forall(x, lambda v: F.abs(v * scale) < F.lit(float(1 << 63)))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    too_large = F.raise_error(F.concat(F.lit("a component of vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")), F.lit(f" times {scale} does not fit into 64 bits"))).cast("array<bigint>")
    return embeddings.select("vec_id", F.when(usable & fits, whole).when(usable, too_large).alias("vector"))


def op9_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(whole_numbers(table(spark, sf_dir, "embeddings")), lambda i: F.pmod(i, F.lit(20)) == 0)


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS "rank", vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
