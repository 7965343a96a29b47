"""Near-duplicates, spans and sharding against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxframe.llm import minhash, sharding, spans, tables
from fluxframe.llm.arrays import LOWER, RangeHash, text_bytes


def corpus(seed, copies=(1, 2, 3, 25)):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(3000)]
    rows = []
    for _ in range(10):
        source = [rng.choice(base) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.choice(copies)):
            words = list(source)
            for _ in range(rng.randint(0, max(1, len(words) // 7))):
                words[rng.randrange(len(words))] = rng.choice(base)
            rows.append((len(rows), " ".join(words)))
    n = len(rows)
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE \n"), (None, "one"), (0, rows[0][1]), (n + 4, "Ein Ümlaut hier"), (n + 5, "ein Ümlaut  HIER")]
    rng.shuffle(rows)
    return rows


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    sets, parent = [(d, shingles(t, width)) for d, t in rows], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return sorted((str(d), len(s), str(find(d) if d is not None else None), d is None or find(d) == d) for d, s in sets)


@pytest.mark.parametrize("seed, width, block", [(1, 2, 512), (2, 2, 4), (3, 5, 6)])
def test_near_duplicates(spark, docs_of, monkeypatch, seed, width, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(seed)
    got = minhash.near_duplicates(docs_of(rows), width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, width)


def test_no_documents(docs_of):
    assert minhash.near_duplicates(docs_of([]), 2).count() == 0
    assert minhash.near_duplicates(docs_of([(1, None), (2, "")]), 2).filter("kept and component_id = doc_id and n_shingles = 0").count() == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_query_agrees_with_sql(spark, sf, same_as_sql):
    same_as_sql(minhash.op2_minhash(spark, sf), minhash.SQL)


PASSAGE = " ".join(f"passage{i} of words{i}." if i % 4 == 3 else f"passage{i} of words{i}" for i in range(20))


def prose(rng, n):
    return " ".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(3, 14))) + rng.choice(".!?") for _ in range(n))


def test_spans(docs_of):
    rng = random.Random(6)
    rows = [(k, prose(rng, 8)) for k in range(10)]
    for k in (3, 5, 8):
        rows[k] = (k, prose(rng, 3) + "\n" + PASSAGE + "\n" + prose(rng, 3))
    once = prose(rng, 4)
    rows += [(20, once + "\n" + PASSAGE.upper().replace(" ", "  ") + "\n" + once), (30, None), (31, ""), (32, "One."), (33, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    out = spans.remove_repeats(docs_of(rows), report=True)
    assert out.columns == docs_of([]).columns + ["n_sentences", "removed"]
    got = {(r.doc_id, k): r for k, r in enumerate(sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, []).append(r)
    for d in (2, 3, 4, 6, 7, 9):  # unrelated texts and the passage's first place stay as they are
        assert [r.text for r in by[d]] == [t for i, t in rows if i == d] and not by[d][0].removed
    for d in (5, 8, 20):
        assert "passage" not in by[d][0].text.lower()
    assert once[:20] in by[20][0].text and by[20][0].text.count(once[:20]) == 1
    assert by[30][0].text is None and by[31][0].text == "" and by[32][0].text == "One."
    assert by[33][0].text.strip() == "" and [r.text for r in by[0]] == [rows[0][1]] * 2
    assert by[None][0].text == rows[1][1] and by[1][0].text.strip() == ""  # a null id orders first


def test_spans_without_punctuation(docs_of):
    rng = random.Random(8)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(120))
    rows = [(k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(90)) + " " + shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(90))) for k in range(3)]
    got = {r.doc_id: r.text for r in spans.remove_repeats(docs_of(rows)).collect()}
    left = [len(set(got[k].split()) & set(shared.split())) for k in range(3)]
    assert left[0] == 120 and max(left[1:]) < 50 and all(len(re.findall(r"\bu\d+", got[k])) > 150 for k in range(3))


@pytest.mark.parametrize("ends", [0, 0.02, 0.05, 0.1, 0.3])
def test_every_passage_over_50_words_holds_a_span(ends):
    """Passages of 51 words put in the middle of other texts, with few ends or many: both places have a span in common."""
    rng = random.Random(9)
    some = lambda n, end: " ".join(f"v{rng.randrange(10**6)}" + ("." if rng.random() < end else "") for _ in range(n))
    passages = [some(51, ends) for _ in range(400)] + ["same " * 51]
    sets = []
    for _ in range(2):
        data, offsets = text_bytes(pa.array([some(rng.randint(0, 40), 0.05) + " " + p + " " + some(rng.randint(0, 40), 0.05) for p in passages]))
        found = spans.Sentences(data, offsets)
        i, _, h = found.spans()
        sets.append([set(h[found.row[i] == k].tolist()) for k in range(len(passages))])
    assert [k for k, (a, b) in enumerate(zip(*sets, strict=True)) if not a & b] == []


def test_spans_empty(docs_of):
    assert spans.remove_repeats(docs_of([])).count() == 0
    assert {r.text for r in spans.remove_repeats(docs_of([(1, None), (2, " ")])).collect()} == {None, " "}


def test_shards(spark, docs_of):
    rows = [(k % 900, f"t{k % 300}") for k in range(1000)] + [(None, None)] * 3
    df = docs_of(rows).withColumns({"shard": F.lit("clash"), "slot": F.lit(0)})
    out = sharding.shard_rows(df, 8, rows_of_part=100).collect()
    count = Counter(r.shard for r in out)
    assert sorted(count.values()) == [125] * 5 + [126] * 3 and set(count) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(count[s]))
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    assert Counter(out) == Counter(sharding.shard_rows(df, 8, rows_of_part=100).collect())
    assert sharding.shard_rows(docs_of([])).count() == 0
    assert len(sharding.shard_rows(docs_of(rows[:3]), 8).collect()) == 3


@pytest.mark.parametrize("partitions, rows_of_part, most_parts", [(1, 40, 64), (7, 10, 1000), (9, 4096, 4), (5, 30, 7)])
def test_shards_follow_the_matrix(spark, partitions, rows_of_part, most_parts):
    """Brute force: the rows of each part are counted again, and the matrix of these counts is what came to the shards."""
    n = 500
    df = spark.range(0, n, 1, partitions)
    out = sharding.shard_rows(df, 3, 5, rows_of_part, most_parts).collect()
    assert sorted(r.id for r in out) == list(range(n))
    shard = {r.id: r.shard for r in out}
    each = max(1, min(most_parts // partitions, -(-n // (partitions * rows_of_part))))
    parts = {}
    for k, rows in enumerate(df.rdd.glom().collect()):
        for place, r in enumerate(rows):
            parts.setdefault((k * each + place // rows_of_part % each) % most_parts, []).append(r.id)
    assert len(parts) <= most_parts
    names = sorted(parts)
    want = sharding.matrix([len(parts[p]) for p in names], [167, 167, 166], 5)
    assert [[sum(shard[i] == s for i in parts[p]) for s in range(3)] for p in names] == want


def test_shuffle_is_uniform(spark):
    """Over many seeds, each of six rows comes to each shard and slot equally often."""
    df = spark.range(6).withColumnRenamed("id", "doc_id")
    seen = Counter((r.doc_id, r.shard, r.slot) for seed in range(60) for r in sharding.shard_rows(df, 2, seed=seed * 17, rows_of_part=2).collect())
    assert len(seen) == 36 and max(seen.values()) < 25


def test_matrix():
    rng = random.Random(1)
    for _ in range(30):
        counts = [rng.randrange(40) for _ in range(9)]
        n = sum(counts)
        sizes = [n // 4 + (i < n % 4) for i in range(4)]
        m = sharding.matrix(counts, sizes, rng.random())
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    draws = Counter(sharding.hypergeometric(random.Random(k), 4, 6, 5) for k in range(6000))
    want = {0: 6, 1: 60, 2: 120, 3: 60, 4: 6}
    assert all(abs(draws[x] - 6000 * w / 252) < 5 * (6000 * w / 252) ** 0.5 for x, w in want.items())
    big = sharding.hypergeometric(random.Random(1), 10**12, 7 * 10**12, 10**8)
    assert abs(big - 12_500_000) < 6 * 3400


def test_blocks_are_bounded_whoever_is_linked(spark):
    """A bucket of 50,000 members that are not linked, and one of which all but 40 are: groups of two blocks, where each
    two members that are apart meet."""
    big = spark.range(50_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("doc_id"), F.col("id").alias("component"))
    assert minhash.met_blocks(big).groupBy("key", "inner", "i", "j").count().agg(F.max("count")).first()[0] <= 2 * minhash.BLOCK
    half = spark.range(3000).select(F.lit(2).cast("long").alias("key"), F.col("id").alias("doc_id"), F.when(F.col("id") < 2960, 0).otherwise(F.col("id")).cast("long").alias("component"))
    groups = {}
    for r in minhash.met_blocks(half).collect():
        groups.setdefault((r.inner, r.i, r.j), []).append(r)
    assert max(map(len, groups.values())) <= 2 * minhash.BLOCK
    met = Counter()
    for (inner, i, j), rows in groups.items():
        for a in rows:
            for b in rows:
                if a.component != b.component and (a.doc_id < b.doc_id if not inner and i == j else a.left and not b.left):
                    met[min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id)] += 1
    assert len(met) == 40 * 2960 + 40 * 39 // 2 and set(met.values()) == {1}


@pytest.mark.parametrize("rows", [2000, 40])
def test_spread_join(spark, monkeypatch, rows):
    monkeypatch.setattr(tables, "HEAVY", 16)
    left = spark.range(rows).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("salt"))
    right = spark.range(rows).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    out = tables.spread_join(left, right, ["k"], ["salt"])
    assert out.columns == ["k", "salt", "twice"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_spread_join_deals_a_hot_key(spark):
    """With 80 % of the rows on one key and adaptive execution off, the largest task has less than twice the mean."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(40_000).select(F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("own"))
        right = spark.range(40_000).select(F.col("id").alias("k"), F.lit(1).alias("one"))
        for how, by in (("inner", ["own"]), ("left", [F.rand(3)])):
            sizes = [r["count"] for r in tables.spread_join(left, right, ["k"], by, how).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 40_000 and len(sizes) == 4 and max(sizes) < 2 * 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def sentences_of(text):
    """The rule of the docstring, word by word: (words of each sentence, its bytes)."""
    raw = text.encode()
    found = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    if not found:
        return []
    data = np.frombuffer(raw, np.uint8)
    h = RangeHash(LOWER[data])(np.array([m.start() for m in found]), np.array([m.end() for m in found])).tolist()
    n = len(found)
    end = [k == n - 1 or found[k][0][-1:] in b".!?" or b"\n" in raw[found[k].end() : found[k + 1].start()] for k in range(n)]
    cut, start = list(end), 0
    for k in range(n):
        if end[k]:
            if k - start + 1 > spans.LONG:
                for w in range(start, k - spans.WINDOW + 2):
                    least = min(h[w : w + spans.WINDOW])
                    cut[max(i for i in range(w, w + spans.WINDOW) if h[i] == least)] = True
            start = k + 1
    out, first = [], 0
    for k in range(n):
        if cut[k]:
            begin = found[first].start() if first else 0
            out.append(([m[0].lower() for m in found[first : k + 1]], raw[begin : found[k + 1].start() if k + 1 < n else len(raw)]))
            first = k + 1
    return out


def spans_brute(rows):
    """What is left of each document of (doc_id, text), ids being different: every span of each is looked up by its words."""
    seen, left = set(), {}
    for doc, text in sorted(rows):
        parts = sentences_of(text)
        size = [len(w) for w, _ in parts]
        pairs = set()
        for i in range(len(parts)):
            j = next((j for j in range(i + spans.LEAST - 1, len(parts)) if sum(size[i : j + 1]) >= spans.MIN_WORDS), None)
            pairs |= {(i, j)} if j is not None else set()
            k = next((k for k in range(i - spans.LEAST + 1, -1, -1) if sum(size[k : i + 1]) >= spans.MIN_WORDS), None)
            pairs |= {(k, i)} if k is not None else set()
        gone = set()
        for i, j in sorted(pairs):
            key = tuple(w for words, _ in parts[i : j + 1] for w in words)
            if key in seen:
                gone |= set(range(i, j + 1))
            seen.add(key)
        left[doc] = b"".join(b for k, (_, b) in enumerate(parts) if k not in gone).decode() if parts else text
    return left


@pytest.mark.parametrize("seed, ends", [(1, 0.2), (2, 0.03), (3, 0.0), (4, 0.6)])
def test_spans_like_brute_force(docs_of, seed, ends):
    rng = random.Random(seed)
    word = lambda: f"Wort{rng.randrange(4000)}" + (rng.choice(".!?") if rng.random() < ends else "")
    passages = [[word() for _ in range(rng.randint(5, 90))] for _ in range(12)]
    rows = []
    for k in range(60):
        words = [x for _ in range(rng.randint(0, 4)) for x in (rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 60))])]
        rows.append((k, "".join(w + rng.choice([" ", " ", "  ", "\t", "\n" if rng.random() < ends else " "]) for w in words)))
    want = spans_brute(rows)
    got = {r.doc_id: r.text for r in spans.remove_repeats(docs_of(rows).repartition(7)).collect()}
    assert got == want and sum(want[k] != t for k, t in rows) > 10
