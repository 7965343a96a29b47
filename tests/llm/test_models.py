"""The classifier and the mixture: held-out accuracy, exact pooling, fitted totals."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe.llm import bytecnn, mixing
from fluxframe.llm.tables import table

ODD = [(1, None), (2, ""), (3, "x"), (4, "é" * 9), (5, "word " * 60_000), (5, "x"), (None, "no id")]


def model_of(seed=1):
    rng = np.random.default_rng(seed)
    shapes = {"embed": (256, bytecnn.EMBED), "filters": (2 * bytecnn.BLOCK * bytecnn.EMBED, bytecnn.FILTERS), "bias": (bytecnn.FILTERS,), "hidden": (bytecnn.FILTERS, bytecnn.HIDDEN), "hidden_bias": (bytecnn.HIDDEN,), "out": (bytecnn.HIDDEN,), "out_bias": (1,)}
    return {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}


def test_pooling_covers_whole_texts(monkeypatch):
    monkeypatch.setattr(bytecnn, "STRIP", 7)
    rng, model = random.Random(2), model_of()
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 8, 9, 50, 400, 3, 64)]
    data, starts = bytecnn.blocks(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    got = bytecnn.pooled(model, data, starts)
    for t, row in zip(texts, got, strict=True):
        t = t + bytes(max(8, -(-len(t) // 4) * 4) - len(t))
        chunks = np.stack([model["embed"][np.frombuffer(t[k : k + 8], np.uint8)].ravel() for k in range(0, len(t) - 7, 4)])
        assert row == pytest.approx((chunks @ model["filters"]).max(0), abs=1e-4)


def test_gradient_learns():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc def", k=rng.randint(5, 90))) for _ in range(300)]
    labels = np.array([k % 2 for k in range(300)])
    texts = [(t if y else t[:9] + "!!" + t[9:]).encode() for t, y in zip(texts, labels, strict=True)]
    model = bytecnn.fit(texts[:200], labels[:200], epochs=25)
    p = bytecnn.probabilities(model, np.frombuffer(b"".join(texts[200:]), np.uint8), np.append(0, np.cumsum([len(t) for t in texts[200:]])))
    assert ((p > 0.5) == labels[200:]).mean() > 0.95


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in bytecnn.op6_bytecnn(spark, sf).collect()}
    labels = table(spark, sf, "labels").collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in rows.items())
    held = [(rows[r.doc_id].score, r.quality) for r in labels if rows[r.doc_id].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_scores_of_odd_rows(spark, docs_of):
    docs = docs_of(ODD)
    got = bytecnn.score(docs, model_of(), ["doc_id", "key", "text"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    same = {r.text: r.score for r in got}
    assert same[None] == same[""] and len({r.score for r in got if r.text == "x"}) == 1
    none = bytecnn.train(docs, docs.select("doc_id", F.lit(None).cast("int").alias("label")))
    assert none is None and {r.score for r in bytecnn.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert bytecnn.score(docs_of([]), model_of(), ["doc_id"]).count() == 0


def predicted(spark, rows):
    return spark.createDataFrame([([float(x) for x in p], int(n)) for p, n in rows], "posterior array<double>, tokens long").repartition(3)


def totals(df, g, k):
    rows = [(np.array(r.posterior), r.tokens, r.r) for r in df.withColumn("r", mixing.rate_of(F.col("posterior"), g)).collect()]
    assert all(r >= 0 and r == pytest.approx(mixing.rates(p, g)) for p, _, r in rows)
    return sum(n * r * p for p, n, r in rows)


def test_rates_match_targets(spark):
    rng = np.random.default_rng(4)
    df = predicted(spark, [(rng.dirichlet(np.full(3, 0.4)), n) for n in rng.integers(1, 1000, 60)])
    n = df.agg(F.sum("tokens")).first()[0]
    weights = [0.2, 0.5, 0.3]
    assert totals(df, mixing.fit_rates(df, weights), 3) == pytest.approx(np.array(weights) * n, rel=1e-5)
    assert totals(df, mixing.fit_rates(df, weights, n / 2), 3) == pytest.approx(np.array(weights) * n / 2, rel=1e-5)


def test_rates_at_the_bound_are_least_squares(spark):
    """Two domains that always come with a third: its target can't be met, and no step of brute force does better."""
    rows = [((1, 0, 0), 100), ((0.5, 0.5, 0), 300), ((0.25, 0, 0.75), 200), ((0, 0, 1), 100)]
    n, k = 700, 3
    target = np.array([0.05, 0.6, 0.35]) * n
    p, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]) / n
    metric = np.linalg.pinv((p * w[:, None]).T @ p)
    loss = lambda t: (t / n - target / n) @ metric @ (t / n - target / n)
    df = predicted(spark, rows)
    got = totals(df, mixing.fit_rates(df, list(target / n), n, 300), k)
    r = np.ones(len(rows))
    for _ in range(20000):
        r = np.maximum(0, r - p @ metric @ (p.T @ (w * r) - target / n))
    assert loss(got) == pytest.approx(loss(n * p.T @ (w * r)), abs=1e-6)


@pytest.mark.parametrize("shares", [(0.05, 0.6, 0.3, 0.05), (0.6, 0.2, 0.1, 0.1), (0.02, 0.9, 0.04, 0.04)])
def test_rates_of_over_represented_domains(spark, shares):
    """The query's weights and number of passes, where rates meet the bound 0."""
    rng = np.random.default_rng(7)
    df = predicted(spark, [(rng.dirichlet(np.full(4, 0.05) + 3 * np.eye(4)[d]), 100) for d in rng.choice(4, 3000, p=shares)])
    assert totals(df, mixing.fit_rates(df, list(mixing.WEIGHTS)), 4) == pytest.approx(np.array(mixing.WEIGHTS) * 300_000, rel=1e-4)


def test_rates_of_a_domain_without_mass(spark):
    df = predicted(spark, [((0.9, 0.1, 0), 10), ((0.2, 0.8, 0), 30)])
    got = totals(df, mixing.fit_rates(df, [0.4, 0.4, 0.2]), 3)
    assert got == pytest.approx([16, 16, 0], rel=1e-4)


def test_rates_out_of_passes_warn(spark):
    """The corpus keeps its rates of 1 where no pass is allowed, and the error is told."""
    with pytest.warns(UserWarning, match="after 0 passes"):
        g = mixing.fit_rates(predicted(spark, [((1, 0), 100), ((0, 1), 300)]), [0.5, 0.5], 400, 0)
    assert (g == 0).all()


def test_mixing_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = mixing.op1_mixing(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    tokens = {r.doc_id: len((r.text or "").split()) for r in table(spark, sf, "documents").collect()}
    assert all(r.tokens == tokens[r.doc_id] and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    n = sum(r.tokens for r in rows)
    for d, w in zip(mixing.DOMAINS, mixing.WEIGHTS, strict=True):
        assert sum(r.tokens * r.rate * r["p_" + d.replace(" ", "_")] for r in rows) == pytest.approx(w * n, rel=1e-5)
        assert sum(r.tokens * r.copies * r["p_" + d.replace(" ", "_")] for r in rows) == pytest.approx(w * n, rel=0.2)
    assert sum(r.copies * r.tokens for r in rows) == pytest.approx(n, rel=0.1)


def test_mixing_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None), (None, 1)], "doc_id long, label int")
    out = mixing.mixed(docs_of(ODD).withColumn("rate", F.lit("clash")).drop("rate"), labels, (0.5, 0.5), ["doc_id", "key"]).collect()
    assert len(out) == len(ODD) and all(sum(r.posterior) == pytest.approx(1) and r.rate >= 0 for r in out)
    none = mixing.mixed(docs_of(ODD), labels.limit(0), (0.5, 0.5), ["doc_id"]).collect()
    assert {tuple(r.posterior) for r in none} == {(0.5, 0.5)}
    assert mixing.mixed(docs_of([]), labels, (0.5, 0.5), ["doc_id"]).count() == 0
