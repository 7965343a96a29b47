"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes, in DataFrame functions.

1. Rows get the id of their partition and place, and are written with it as a table, so that every later pass, and a task
   repeated after a lost executor, sees the same rows in the same partitions. A partition, or a stretch of rows_of_part rows of
   a large one, or several partitions where there are very many, is a part; a part's rows are counted.
2. The matrix C[part, shard] says how many rows of a part go to a shard. In a uniform shuffle its rows follow, one after
   another, the multivariate hypergeometric law of what each shard has still free. It is drawn for whole parts on the
   driver from their counts, at most `most_parts` of them, never from rows. Beyond rows_of_part * most_parts rows parts grow.
3. Each part is permuted (ranked by a hash of id and seed), and cut at the sums of its row of C: that is the exchange.
4. Each shard is permuted again. A shard's rows fall into buckets by a second hash, buckets are counted, and a row's
   slot is its rank in its bucket after all rows of the buckets before, so that no task sorts a whole shard.

No row's place depends on its content, so frequent values make no large task. The sizes of shards differ by one row at most
(law `rows`).

Defined results: an empty table gives no rows; equal rows, ties and nulls get places of their own like all others; texts of any
length move whole; all columns stay, and shard (int) and slot (long) are added, in place of columns of those names.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.llm.tables import at, fresh, keep, table, without

#: Rows that a part or a bucket is meant to have, and how many parts there are at most.
ROWS_OF_PART, MOST_PARTS = 4096, 1 << 14


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` from good + bad are good: inverse of the distribution function, summed over 14 deviations
    around the mode by the ratio of neighbouring probabilities."""
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(drawn * (good / total) * (bad / total) * (total - drawn) / max(1, total - 1))
    reach = int(14 * spread) + 20
    first, last = max(low, mode - reach), min(high, mode + reach)
    down, p = [], 1.0
    for x in range(mode, first, -1):  # p(x - 1) / p(x)
        p *= x * (bad - drawn + x) / ((good - x + 1) * (drawn - x + 1))
        down.append(p)
    up, p = [], 1.0
    for x in range(mode, last):  # p(x + 1) / p(x)
        p *= (good - x) * (drawn - x) / ((x + 1) * (bad - drawn + x + 1))
        up.append(p)
    sums = list(accumulate([*reversed(down), 1.0, *up]))
    return first + min(len(sums) - 1, bisect_left(sums, rng.random() * sums[-1]))


def matrix(counts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """C[part][shard], whose rows sum to counts and whose columns sum to shards."""
    rng, free, left = random.Random(seed), list(shards), sum(shards)
    out = []
    for n in counts:
        row, rest, pool = [], n, left
        for i, f in enumerate(free):
            x = hypergeometric(rng, f, pool - f, rest)
            row.append(x)
            free[i] -= x
            rest -= x
            pool -= f
        left -= n
        out.append(row)
    return out


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 11, rows_of_part: int = ROWS_OF_PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """df with shard and slot; the i-th shard has total // shards rows, and one more if i < total % shards."""
    if shards < 1:
        raise ValueError("at least one shard")
    spark = df.sparkSession
    df = df.select(*without(df, "shard", "slot"))
    at_, part_, rank, cuts_, bucket, n, before = fresh([*df.columns, "shard", "slot"], "at", "part", "rank", "cuts", "bucket", "n", "before")
    rows = df.withColumn(at_, F.monotonically_increasing_id())
    rows = at(spark, keep(rows, "rows-to-shard"), rows)
    total, last = rows.agg(F.count("*"), F.max(F.shiftright(at_, 33))).first()
    partitions = (last or 0) + 1
    # Parts of a partition: as many as its mean size asks for, within most_parts of all.
    each = max(1, min(most_parts // partitions, -(-total // (partitions * rows_of_part))))
    stretch = F.pmod(F.floor(F.col(at_).bitwiseAND(F.lit((1 << 33) - 1)) / rows_of_part), F.lit(each))
    part = F.pmod(F.shiftright(at_, 33) * each + stretch, F.lit(most_parts)).cast("int")
    # at most most_parts rows come to the driver
    counts = {r[part_]: r[n] for r in rows.groupBy(part.alias(part_)).agg(F.count("*").alias(n)).collect()}
    names = sorted(counts)
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    drawn = matrix([counts[p] for p in names], sizes, seed)
    cuts = spark.createDataFrame([(p, list(accumulate(row))) for p, row in zip(names, drawn, strict=True)], f"{part_} int, {cuts_} array<long>")

    key = lambda k: F.xxhash64(F.lit(seed + k), at_)
    local = Window.partitionBy(part_).orderBy(key(1), at_)
    ranked = rows.withColumn(part_, part).withColumn(rank, F.row_number().over(local)).join(F.broadcast(cuts), part_)
    sent = ranked.withColumn("shard", F.size(F.filter(cuts_, lambda c: c < F.col(rank)))).drop(part_, cuts_, rank)

    buckets = min(most_parts, max(1, -(-total // (shards * rows_of_part))))
    sent = sent.withColumn(bucket, F.pmod(key(2), F.lit(buckets)).cast("int"))
    again = Window.partitionBy("shard", bucket).orderBy(key(3), at_)
    placed = sent.withColumn(rank, F.row_number().over(again))
    # Bucket sizes: at most shards * most_parts rows, added up within each shard.
    held = sent.groupBy("shard", bucket).agg(F.count("*").alias(n))
    held = held.withColumn(before, F.sum(n).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(n)).drop(n)
    out = placed.join(held, ["shard", bucket])
    return out.withColumn("slot", F.col(before) + F.col(rank) - 1).select(*df.columns, "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest columns are made before the exchanges, which then move them in the place of the texts.
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard_rows(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
