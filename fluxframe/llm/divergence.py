"""Source divergence audit: which sources of a language differ most, and by which terms, with bounds that spare most terms.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the V terms that at least
`least` of its documents hold. A group, which is a source of a language or the language as a whole, with N occurrences of
kept terms gives a term with n of them the share p = 1 + floor(10**9 * (n + 2) / (N + 2 * V)); two shares are apart by
floor((p - q)**2 / (p + q)). All sums are exact: shares are divided as decimals.

* Pairs of sources add up that distance over all kept terms, from postings (the sources of a term): a sum starts as if both
  sources lacked every term, adds what either source's own terms change, counted by their number of occurrences, and corrects
  the terms that both hold. A task adds the corrections of its terms up before they are exchanged.
* Terms of a source whose share is above the language's: the terms of a group fall into buckets by the bits of their count. No
  term of a bucket is farther than its largest share is from its least share of the language. Best first, the buckets that
  hold TOP such terms are evaluated; then only those whose bound isn't below the last of the TOP found.

Defined results: null texts, languages and sources are ''; every row is a document, so copies of a row count as several; a
group without terms has N = 0; with V = 0 pairs are 0 and there are no terms; a source that is alone in its language has no
pairs; ties go to the item that is first in UTF-8; very long texts are counted whole, one at a time; an empty table gives no
rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxframe.llm.arrays import LOWER, gathered, slices, text_bytes, words
from fluxframe.llm.tables import at, drop, keep, table

LEAST, TOP = 10, 10
#: Sums of pairs that a task holds before it hands them on.
PAIRS = 1 << 20
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents), and a row with term '' for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            start, end, row = words(data, offsets, _LETTERS)
            coded = gathered(LOWER[data], start, end).dictionary_encode()
            names = coded.dictionary.cast(pa.string())
            langs, sources = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            code, m = coded.indices.to_numpy().astype(np.int64), max(len(names), 1)
            both, n = np.unique(group[row] * m + code, return_counts=True)
            once = np.unique(row * m + code)
            d = np.unique(group[once // m] * m + once % m, return_counts=True)[1]  # the same keys in the same order
            seen = np.unique(group)
            every = np.append(both // m, seen)
            term = pa.concat_arrays([names.take(pa.array(both % m)), pa.array([""] * len(seen), pa.string())])
            nothing = np.zeros(len(seen), np.int64)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(every // len(sources.dictionary))), sources.dictionary.take(pa.array(every % len(sources.dictionary))), term, pa.array(np.append(n, nothing)), pa.array(np.append(d, nothing))], names=["lang", "source", "term", "n", "d"])

    rows = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, kept: Column) -> Column:
    exact = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (exact(n) + 2), exact(total) + 2 * exact(kept))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def corrections(postings: DataFrame) -> DataFrame:
    """lang, a, b (sources, a before b) and more: what the terms that both hold add to the sums of each alone. postings are
    lang and list, an array of source, p and p0, the share of a term that the source lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}

        def handed() -> pa.RecordBatch:
            keys = list(zip(*sums, strict=True)) or [[], [], []]
            out = pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(sums.values(), pa.int64())], names=["lang", "a", "b", "more"])
            sums.clear()
            return out

        for batch in batches:
            lists, langs = batch.column("list"), batch.column("lang").dictionary_encode()
            entries = lists.flatten()
            if not len(entries):
                continue
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            sources, p, p0 = entries.field("source").dictionary_encode(), *(entries.field(c).to_numpy() for c in ("p", "p0"))
            names = sources.dictionary.to_pylist()
            place = np.argsort(np.argsort(np.array([s.encode() for s in names], object)))[sources.indices.to_numpy()]
            names.sort(key=str.encode)
            order = np.lexsort([place, row])
            row, place, p, p0 = row[order], place[order], p[order], p0[order]
            lang = langs.indices.to_numpy().astype(np.int64)[row]
            for step in range(1, int(np.bincount(row).max())):
                i = np.flatnonzero(row[step:] == row[:-step])
                j = i + step
                more = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
                codes, at_ = np.unique((lang[i] * len(names) + place[i]) * len(names) + place[j], return_inverse=True)
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, at_, more)
                for c, x in zip(codes.tolist(), total.tolist(), strict=True):
                    key = langs.dictionary[c // len(names) ** 2].as_py(), names[c // len(names) % len(names)], names[c % len(names)]
                    sums[key] = sums.get(key, 0) + x
                if len(sums) >= PAIRS:
                    yield handed()
        yield handed()

    return postings.mapInArrow(run, "lang string, a string, b string, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value of all pairs of groups (lang, source, p0, kept), both ways. shares has
    lang, source, term and p, and p0 of its group."""
    side = lambda c: groups.select("lang", F.col("source").alias(c), F.col("p0").alias(f"{c}0"), *(["kept"] if c == "a" else []))
    own = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("n"), F.first("p0").alias("a0"))
    alone = own.join(side("b"), "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (apart(F.col("p"), F.col("b0")) - apart(F.col("a0"), F.col("b0")))).alias("more"))
    postings = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("list")).select("lang", "list")
    base = side("a").join(side("b"), "lang").filter("a <> b").select("lang", "a", "b", F.coalesce(F.col("kept") * apart(F.col("a0"), F.col("b0")), F.lit(0)).alias("more"))
    turned = lambda df: df.union(df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    return base.union(turned(alone)).union(turned(corrections(postings))).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("more").alias("value"))


def top_terms(shares: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a term), value and rank of each group's terms of highest distances among those with p > q. shares
    has lang, source, term, n, p and q."""
    spark = shares.sparkSession
    group = ["lang", "source"]
    shares = shares.withColumn("bucket", F.length(F.bin("n")))
    buckets = shares.groupBy(*group, "bucket").agg(F.max("p").alias("most"), F.min("q").alias("least"), F.count_if(F.col("p") > F.col("q")).alias("m")).filter("m > 0")
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("bound", apart(F.col("most"), F.col("least"))).withColumn("first", before < top).select(*group, "bucket", "bound", "first")
    buckets = at(spark, buckets_path := keep(buckets, "term-buckets"), buckets)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))

    def evaluated(some: DataFrame) -> DataFrame:
        return shares.join(some.select(*group, "bucket"), [*group, "bucket"]).filter("p > q").select(*group, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    best = evaluated(buckets.filter("first")).withColumn("rank", rank).filter(F.col("rank") <= top)
    best = at(spark, keep(best, "best-terms"), best)
    least = best.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
    # Where a group has no last of the top, all its buckets are first.
    rest = evaluated(buckets.filter("not first").join(least, group).filter(F.col("bound") >= F.col("kth")))
    rest = at(spark, keep(rest, "more-terms"), rest)
    drop(spark, buckets_path)
    return best.drop("rank").union(rest).withColumn("rank", rank).filter(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value and rank of docs (lang, source, text)."""
    spark = docs.sparkSession
    counts = term_counts(docs)
    counts = at(spark, counts_path := keep(counts, "term-counts"), counts)
    terms = counts.filter("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total")).filter(F.col("d") >= least).drop("d")
    kept = at(spark, kept_path := keep(kept, "kept-terms"), kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    used = terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_n")
    groups = groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("group_n"), F.col("kept"))))
    groups = at(spark, keep(groups, "term-groups"), groups)
    shares = used.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q"))
    shares = at(spark, keep(shares, "term-shares"), shares)
    drop(spark, counts_path)
    drop(spark, kept_path)
    by_value = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_sums(shares, groups).withColumn("rank", by_value)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").union(out(top_terms(shares, top), "term"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (SELECT a.lang, a.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN s USING (lang, source) LEFT JOIN l USING (lang)),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
