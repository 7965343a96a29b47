"""A corpus pipeline of five stages, each one of the llm operators over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm import bpe, bytecnn, minhash, mixing, spans
from fluxframe.llm.tables import at, drop, fresh, keep, spread_join, table

#: Weights of the clean and the toxic domain; the toxic one is an upper bound.
CLEAN_AND_TOXIC = (0.97, 0.03)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay, null and empty texts and repeated rows scored like any other."""
    model = bytecnn.trained(spark, table(spark, sf_dir, "documents"), sf_dir)
    (name,) = fresh(docs.columns, "score")
    return bytecnn.score(docs, model, docs.columns, name).filter(F.col(name) >= bytecnn.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays: that of the smallest doc_id. Rows are
    decided by doc_id and text, so rows that repeat a doc_id with texts of their own are documents of their own; of rows
    equal in both, the least by the other columns stays. Rows without doc_id all stay, as do texts without words."""
    row, mark, names = *fresh(docs.columns, "row", "mark"), docs.columns
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(row, F.xxhash64("doc_id", "text"))
    groups = minhash.near_duplicates(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias(mark))
    ids = named.select(row, "doc_id").distinct()
    first = groups.distinct().join(ids, row).groupBy(mark).agg(F.min(F.struct("doc_id", row))[row].alias(row)).select(row)
    one = spread_join(named, first, [row], [F.rand(3)]).groupBy(row).agg(F.min(F.struct(*names)).alias(mark)).select(f"{mark}.*")
    return one.union(docs.filter(F.col("doc_id").isNull()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go from the texts; a document of which nothing is left goes, one that was blank or null before
    stays. n_chars, if there is such a column, is counted anew."""
    (blank,) = fresh(docs.columns, "blank")
    empty = F.coalesce(F.trim("text") == "", F.lit(True))
    out = spans.remove_repeats(docs.withColumn(blank, empty)).filter(F.col(blank) | ~empty)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the rates that match the weights of clean and toxic tokens say. The cleanest stay once;
    the more toxic a document, the more it is thinned. Where toxic tokens are below their weight already, all documents stay
    once: repeating them, or dropping clean ones, would only add to their share. A null or empty text has the rate of its
    posterior."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held = fresh([*docs.columns, *mixing.ADDED], *(f"c{i}" for i in range(len(docs.columns))))  # names that mixing doesn't add
    renamed = docs.select("*", *(F.col(c).alias(h) for c, h in zip(docs.columns, held, strict=True) if c not in ("doc_id", "text")))
    kept = [c if c in ("doc_id", "text") else h for c, h in zip(docs.columns, held, strict=True)]
    out = mixing.mixed(renamed, labels, CLEAN_AND_TOXIC, kept, once=0, at_most=1).filter("copies > 0")
    (copy,) = fresh(out.columns, "copy")
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), "copies"))).select(*(F.col(k).alias(c) for k, c in zip(kept, docs.columns, strict=True)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded bytes of every document."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix),
    ("bpe", tokens),
]

#: SQL expresses neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = keep(out, "pipeline-" + name.replace(" ", "-"))
        docs = at(spark, path, out)
        if before:
            drop(spark, before)  # nothing reads it any more
        before = path
    return docs
