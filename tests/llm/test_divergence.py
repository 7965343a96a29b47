"""Source divergence against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxframe.llm import divergence


def brute(rows, least, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for a, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        count = {g: Counter(t for d in own if g in (None, d[1]) for t in d[2] if t in kept) for g in {None, *(d[1] for d in own)}}
        p = {g: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for g, c in count.items()}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for g in count.keys() - {None}:
            pairs = [(h, sum(apart(p[g][t], p[h][t]) for t in kept)) for h in count.keys() - {None, g}]
            terms = [(t, apart(p[g][t], p[None][t])) for t in kept if count[g][t] and p[g][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g, part, t, v, k + 1) for k, (t, v) in enumerate(items[:most])]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "Über", "über", "ÜBER", "日本", "x", "a1b", "it's", "ét", "z\x00q", "naïve\U0001f600"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(rng.choice(["en", "EN", "de", None]), rng.choice(["s1", "s2", "é", "z", None]), " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", "only empty", ""), ("en", "only null", None), ("lone", "one", "w w w"), ("rare", "a", "q"), ("rare", "b", "r"), ("en", "s1", "the " * 5000), *[("en", "s1", "copy of a row")] * 12]


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").select("*", *(F.lit("own").alias(c) for c in ("term", "n", "p", "bucket", "d", "a")))


@pytest.mark.parametrize("seed, least, top, held", [(1, 10, 10, 1 << 20), (2, 3, 2, 4), (3, 500, 3, 1)])
def test_brute_force(spark, monkeypatch, seed, least, top, held):
    monkeypatch.setattr(divergence, "PAIRS", held)
    rows = corpus(seed)
    got = divergence.audit(table(spark, rows).repartition(5), least, top)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_large_counts_and_empty(spark):
    """Shares of counts whose product with 10**9 is over 64 bits."""
    rows = spark.createDataFrame([(10**12, 10**13, 5), (0, 0, 3)], "n long, total long, kept long")
    got = [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * k) for n, t, k in ((10**12, 10**13, 5), (0, 0, 3))]
    assert divergence.audit(table(spark, corpus(1)).filter("false")).collect() == []


def test_bounds_spare_buckets(spark, tmp_path):
    """Buckets whose bound is below the last of the top aren't evaluated; one of an equal bound is."""
    shares = [("l", "s", f"t{k:03}", n, 10, p, q) for k, (n, p, q) in enumerate([(1 << 40, 10**8, 10)] * 2 + [(1 << 30, 10**6, 10**5)] * 3 + [(1 << 20, 2000, 1000)] * 50)]
    df = spark.createDataFrame(shares, "lang string, source string, term string, n long, p0 long, p long, q long")
    kept = []
    original = divergence.keep
    divergence.keep = lambda d, label: kept.append((label, original(d, label))) or kept[-1][1]
    try:
        got = divergence.top_terms(df, 3).collect()
    finally:
        divergence.keep = original
    assert sorted((r["rank"], r["item"]) for r in got) == [(1, "t000"), (2, "t001"), (3, "t002")]
    sizes = {label: spark.read.parquet(path).count() for label, path in kept if label != "term-buckets"}
    assert sizes == {"best-terms": 3, "more-terms": 0}
