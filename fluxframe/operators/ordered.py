"""Rows in order without a task per key: what comes before a row, and running sums, over blocks of the order.

A key's rows are cut into blocks of `span` numbers of their order. Windows run within (key, block), so a key is as many tasks
as it has blocks. What a block needs of those before it is a row: the last row of the block before, or the sum of all before.
These come from a small second pass over a table of a row a block, and join their block as one more row that sorts first, so
the rows themselves are shuffled once and joined with nothing.

The order is a whole number or a timestamp's seconds and isn't null; keys can be null. Rows of equal order come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16


def block(order: str | Column, span: int) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.call_function("div", order - F.pmod(order, F.lit(span)), F.lit(span))


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """df with _c, for each c of columns, its value in the key's row before; null in the first row of a key."""
    rows = df.withColumn("_block", block(order, span))
    taken = list(dict.fromkeys([order, *columns]))
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(*taken), order).alias("_last"))
    following = F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block"))
    ends = last.withColumn("_block", following).filter(F.col("_block").isNotNull()).select(*keys, "_block", "_last.*", F.lit(True).alias("_end"))
    both = rows.withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy(*keys, "_block").orderBy(order)
    return both.withColumns({f"_{c}": F.lag(c).over(before) for c in columns}).filter(~F.col("_end")).drop("_end", "_block")


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, total: str | None = None, span: int = SPAN) -> DataFrame:
    """df with name: the sum of a whole number over the key's rows up to each; with total also its sum over all of them."""
    rows = df.withColumns({"_block": block(order, span), "_value": value})
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_value"))
    up_to = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_value").over(up_to), F.lit(0)).alias("_value"), F.sum("_value").over(Window.partitionBy(*keys)).alias("_total"), F.lit(True).alias("_start"))
    both = rows.withColumn("_start", F.lit(False)).unionByName(starts, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_block").orderBy(F.desc("_start"), order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_sum", F.sum("_value").over(so_far))
    if total:
        out = out.withColumn(total, F.first("_total").over(so_far))  # the start's, as it sorts first
    return out.filter(~F.col("_start")).drop("_value", "_block", "_start", "_total").withColumnRenamed("_sum", name)
