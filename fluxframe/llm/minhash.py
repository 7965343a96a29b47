"""Near-duplicates: many universal hash minima with banding, verification, and components by large-star and small-star.

A document's set holds its distinct runs of `width` words (lower-cased A-Z, split at ASCII white space); a shorter text is
one run. Two documents are linked if 100 * intersection >= percent * union. The steps:

1. signatures(): per text the set's size, a 128-bit fingerprint, HASHES minima of (a * x + b) >> 32 and BANDS keys of
   ROWS minima each. At similarity 0.8 a pair shares a key with probability 1 - 5e-8.
2. Documents of equal fingerprint are one class, named by the smallest doc_id; only classes go on.
3. Keys of two classes or more make buckets. Star edges go from each member to a leader, which each bucket draws by a
   hash, so a hot bucket yields one edge a member. Edges are verified by signature, then on the full sets.
4. Components of the verified edges join most of each bucket. What is still apart within a bucket is compared by signatures,
   a pair of blocks at a time. Members of a bucket's largest component, which need not meet each other, are cut into inner
   blocks, the others into outer ones; each inner block meets each outer one, and each two outer ones meet, so a group holds
   two blocks however large the bucket and whoever is linked. A bucket of n members, m of them outside its largest
   component, makes about n * m / BLOCK copies of their signatures. Pairs of one component and pairs whose sizes rule them
   out are passed over, and a pair that shares several keys is taken at the first of them. Of the pairs that pass by
   signature, counts settle most: a set's runs are counted in CELLS cells, and the counts of two sets differ by no more than
   the sets do, so a pair whose counts differ too much can't be linked. The rest are verified on full sets. No link is lost
   to a cap.
5. Components by alternating large-star and small-star until no edge changes.

Joins on a node, a leader, a key or a class go through spread_join, so that a hot one is dealt over many tasks.

Defined results: null and empty texts, and those without words: an empty set, linked with nothing; a row without doc_id can't
be named, so it has no component and is kept; rows that repeat a doc_id are one document, whose links are those of all its
texts; equal texts are one class, in the component of its smallest doc_id; very long texts are hashed whole, one at a time;
an empty table gives no rows; columns other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm.arrays import LOWER, U64, RangeHash, mix, slices, text_bytes, words
from fluxframe.llm.tables import at, drop, keep, spread_join, table

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: The most members of a block but for chance: blocks are dealt by hash, FILL of that on average.
BLOCK, FILL = 512, 0.75
#: A pair passes by signature if that many of the HASHES minima agree; at similarity 0.8, 102 do, with a deviation of 4.5.
AGREE = 76
CELLS = 512

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's set, as sorted distinct 64-bit hashes."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    hashes = RangeHash(LOWER[data])(start, end)
    runs = RangeHash(hashes)
    limits = np.searchsorted(row, np.arange(n + 1))
    first = np.arange(len(row))
    last = np.minimum(first + width, limits[row + 1])
    full = (last - first == width) | (first == limits[row])  # a shorter text is one run
    with np.errstate(over="ignore"):
        values = runs(first, last)
    out = []
    for i in range(n):
        lo, hi = limits[i], limits[i + 1]
        out.append(np.unique(values[lo:hi][full[lo:hi]]))
    return out


def minima(values: np.ndarray) -> np.ndarray:
    """HASHES minima over a set that isn't empty."""
    least = np.full(HASHES, (1 << 32) - 1, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(values), 1024):
            h = (values[lo : lo + 1024, None] * _A + _B) >> U64(32)
            np.minimum(least, h.min(0).astype(np.uint32), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ (column.astype(U64) + U64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def cell_counts(values: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each cell; 255 stands for more, which only makes counts more alike."""
    return np.minimum(255, np.bincount((values % U64(CELLS)).astype(np.int64), minlength=CELLS)).astype(np.uint8)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(mix(mix(values)).sum()) ^ len(values)
        b = int(mix(values * U64(0xD1342543DE82EF95) + U64(1)).sum())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a & (1 << 64) - 1, b & (1 << 64) - 1))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (the fingerprint) and keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            sets = shingles(*text_bytes(batch.column("text")), width)
            marks = [fingerprint(s) for s in sets]
            keys = [band_keys(minima(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, signature (a byte of each minimum), bands (four bytes of each key), counts and values, the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            sets = shingles(*text_bytes(batch.column("text")), width)
            least = [minima(s) if len(s) else np.zeros(HASHES, np.uint32) for s in sets]
            marks = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in ([m.astype(np.uint8) for m in least], [band_keys(m).astype(np.uint32) for m in least], map(cell_counts, sets), sets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *marks], names=["doc_id", "n", "signature", "bands", "counts", "values"])

    return docs.mapInArrow(run, "doc_id long, n long, signature binary, bands binary, counts binary, values binary")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, near_already: bool = False) -> DataFrame:
    """The pairs (u, v) that are linked: by signature first, unless that has been done, then on the full sets."""
    by = lambda c, *more: sets.select(F.col("doc_id").alias(c), *(F.col(m).alias(f"{c}_{m}") for m in more))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), HASHES) for c in ("u_signature", "v_signature"))
            batch = batch.filter(pa.array((a == b).sum(1) >= AGREE))
            a, b = (_matrix(batch.column(c), CELLS).astype(np.int16) for c in ("u_counts", "v_counts"))
            total = batch.column("u_n").to_numpy() + batch.column("v_n").to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array((100 + percent) * np.abs(a - b).sum(1, dtype=np.int64) <= (100 - percent) * total))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("u_values"), batch.column("v_values"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    with_ = lambda some, side, other, *more: spread_join(some, by(side, *more), [side], [other])
    close = pairs
    if not near_already:
        sized = with_(with_(pairs, "u", "v", "n", "signature", "counts"), "v", "u", "n", "signature", "counts")
        sized = sized.filter(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
        close = sized.select("u", "v", *(f"{c}_{m}" for m in ("n", "signature", "counts") for c in "uv")).mapInArrow(near, "u long, v long")
        path = keep(close, "close")
        close = at(pairs.sparkSession, path, close)
    return with_(with_(close, "u", "v", "values"), "v", "u", "values").select("u", "v", "u_values", "v_values").mapInArrow(linked, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges (u, v), by large-star and small-star."""
    spark = edges.sparkSession
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    path = keep(pair, "edges")
    now = at(spark, path, pair)
    before = None

    def with_least(edges: DataFrame) -> DataFrame:
        return spread_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), ["u"], ["v"])

    while True:
        # Each node's neighbours go to the least of them and itself: first the larger neighbours, then the smaller ones.
        both = with_least(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        large_path = keep(large, "large-star")
        large = at(spark, large_path, pair)
        small = with_least(large).select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("m")).select("u", F.col("m").alias("v")))
        small = small.filter("u <> v").distinct()
        small_path = keep(small, "small-star")
        drop(spark, path)
        drop(spark, large_path)
        path, now = small_path, at(spark, small_path, pair)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    # All edges now lead from a node to its component's least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = signatures(rows, width)
    signed = at(spark, keep(signed, "signatures"), signed)
    named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = named.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "keys")).alias("r"))
    classes = at(spark, keep(classes, "classes"), classes)  # a table of its own, so that the join of a hot class's copies can be split
    marks = named.select("doc_id", "f1", "f2")
    twins = spread_join(marks, classes.select("f1", "f2", F.col("r.doc_id").alias("rep")), ["f1", "f2"], ["doc_id"])
    twins = twins.filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()

    keyed = classes.select(F.col("r.doc_id").alias("doc_id"), F.explode("r.keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", "doc_id"), "doc_id")).getField("doc_id").alias("leader")).filter("n > 1")
    members = spread_join(keyed, shared, ["key"], ["doc_id"])
    members_path = keep(members, "members")
    members = at(spark, members_path, members)
    some = members.select("doc_id").distinct()
    sets = full_sets(spread_join(rows.filter(F.col("doc_id").isNotNull()), some, ["doc_id"], [F.rand(3)]), width)
    sets_path = keep(sets, "sets")
    sets = at(spark, sets_path, sets)

    stars = members.filter("doc_id <> leader").select(F.col("doc_id").alias("u"), F.col("leader").alias("v")).distinct()
    stars = at(spark, keep(stars, "stars"), stars)
    edges = verified(stars, sets, percent)
    edges_path = keep(edges, "star-edges")
    edges = at(spark, edges_path, edges)
    first = components(edges)

    placed = members.select("key", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = at(spark, keep(placed, "placed"), placed)
    dealt = met_blocks(placed, sets.select("doc_id", "n", "signature", "bands", "counts"))
    rest = dealt.groupBy("key", "inner", "i", "j").applyInArrow(_close_pairs(percent), "u long, v long").distinct()
    rest = at(spark, keep(rest, "close-pairs"), rest)
    more = verified(rest, sets, percent, near_already=True)

    joined = first.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    linked = components(joined.union(more).union(twins))
    has = F.col("doc_id").isNotNull()  # rows without doc_id would all join in one task
    out = spread_join(signed.select("doc_id", "n_shingles").filter(has), linked.withColumnRenamed("node", "doc_id"), ["doc_id"], [F.rand(3)], "left")
    out = out.union(signed.filter(~has).select("doc_id", "n_shingles", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def met_blocks(placed: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """key, inner, i, j, doc_id, component, left: the members (key, doc_id, component) of buckets that are not one component,
    in every pair of blocks where they have to meet others. A group (key, inner, i, j) holds two blocks: inner block i and
    outer block j, or outer blocks i <= j; left marks the members of the first. Only members of one bucket meet. more's
    columns are joined by doc_id before members are repeated, so that no document's copies come together in a task."""
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    apart = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / (BLOCK * FILL)).cast("int")
    apart = apart.select("key", F.col("top.component").alias("largest"), blocks(F.col("top.n")).alias("ins"), blocks(F.col("n") - F.col("top.n")).alias("outs"))
    open_ = spread_join(placed, apart, ["key"], ["doc_id"])
    carried = [] if more is None else [c for c in more.columns if c != "doc_id"]
    open_ = open_ if more is None else open_.join(more, "doc_id")
    inside = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("doc_id", "key"), F.when(inside, F.col("ins")).otherwise(F.col("outs"))).cast("int")
    spot = lambda inner, i, j, left: F.struct(F.lit(inner).alias("inner"), i.alias("i"), j.alias("j"), left.alias("left"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    me, yes, no = F.col("me"), F.lit(True), F.lit(False)
    of_inner = F.transform(up_to(F.col("outs")), lambda j: spot(True, me, j, yes))
    of_outer = F.concat(F.transform(up_to(F.col("ins")), lambda i: spot(True, i, me, no)), F.transform(up_to(F.col("outs")), lambda x: spot(False, F.least(x, me), F.greatest(x, me), me <= x)))
    return open_.withColumn("me", own).select("key", "doc_id", "component", *carried, F.explode(F.when(inside, of_inner).otherwise(of_outer)).alias("s")).select("key", "s.*", "doc_id", "component", *carried)


def _close_pairs(percent: int) -> Callable[[pa.Table], pa.Table]:
    def close(group: pa.Table) -> pa.Table:
        ids, comp, n, left = (group.column(c).to_numpy() for c in ("doc_id", "component", "n", "left"))
        key = group.column("key")[0].as_py() & (1 << 32) - 1
        same_block = not group.column("inner")[0].as_py() and group.column("i")[0].as_py() == group.column("j")[0].as_py()
        marks, counts = _matrix(group.column("signature"), HASHES), _matrix(group.column("counts"), CELLS).astype(np.int16)
        bands = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.uint32).reshape(-1, BANDS)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in np.flatnonzero(left):
            b = np.flatnonzero(ids > ids[a]) if same_block else np.flatnonzero(~left)
            b = b[(comp[b] != comp[a]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))]
            b = b[(marks[b] == marks[a]).sum(1) >= AGREE] if len(b) else b
            if len(b):
                same = bands[b] == bands[a]
                b = b[bands[a][same.argmax(1)] == key]
                # |A - B| + |B - A| <= (100 - p) / (100 + p) * (|A| + |B|) for linked sets
                apart = np.abs(counts[b] - counts[a]).sum(1, dtype=np.int64)
                b = b[(100 + percent) * apart <= (100 - percent) * (n[b] + n[a])]
            us.append(np.full(len(b), ids[a]))
            vs.append(ids[b])
        us, vs = np.concatenate(us), np.concatenate(vs)
        return pa.table({"u": np.maximum(us, vs), "v": np.minimum(us, vs)})

    return close


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Exact Jaccard similarity of all pairs that share a run; copies count by their class, so that no pairs within a class arise.
SQL = """
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS set FROM t
),
c AS (SELECT min(doc_id) AS rep, set FROM s WHERE len(set) > 0 GROUP BY set),
x AS (SELECT rep, len(set) AS n, unnest(set) AS g FROM c),
p AS (
    SELECT a.rep AS u, b.rep AS v, a.n + b.n AS total, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
),
l AS (SELECT u, v FROM p WHERE 100 * shared >= 80 * (total - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.set = s.set LEFT JOIN m ON m.node = c.rep
"""
