"""The pipeline's stages on the smallest tables, and its contract."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluxframe import llm
from fluxframe.llm import mixing
from fluxframe.llm.tables import table


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    sizes, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.dtypes == docs.dtypes, name
        path = corpus_pipeline.keep(out, "test")
        before = corpus_pipeline.at(spark, path, out)
        sizes.append(before.count())
        assert before.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and 0.4 * sizes[0] < sizes[-1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert last.count() == sizes[-1]


def test_run(spark, tmp_path):
    """All of it over a few documents: a row for each copy of each document kept."""
    rows = [(k, " ".join(f"w{k}x{i} is good." for i in range(30)), "en", "s", 1) for k in range(6)] + [(9, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {r.doc_id for r in got.collect()} >= set(range(6))


def test_stages_take_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_near_dedup_keeps_rows_without_id(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (2, text + " more"), (2, text + " more"), (None, text), (None, text), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == ["1", "3", "4", "None", "None"]


@pytest.mark.parametrize("toxic", [6, 40, 400])
def test_mix_matches_weights_at_any_share(spark, sf, monkeypatch, toxic):
    """Of 1000 documents of 20 words some are toxic: under, a little over and far over the weight of 3%, which is a bound."""
    n = 1000
    exact = {"clean": [1.0, 0.0], "toxic": [0.0, 1.0]}
    docs = spark.createDataFrame([(i, " ".join(["toxic" if i < toxic else "clean"] * 20), "en", "s", 119) for i in range(n)], table(spark, sf, "documents").schema)
    monkeypatch.setattr(mixing, "train", lambda *_: None)
    parts = F.when(F.col("text").startswith("toxic"), F.array(*map(F.lit, exact["toxic"]))).otherwise(F.array(*map(F.lit, exact["clean"])))
    monkeypatch.setattr(mixing, "with_posteriors", lambda d, w, k, columns: d.withColumns({"tokens": F.lit(20).cast("long"), "posterior": parts}).select(*columns, "tokens", "posterior"))
    got = [r.doc_id for r in corpus_pipeline.mix(spark, docs, sf).collect()]
    assert sorted(i for i in got if i >= toxic) == list(range(toxic, n))
    assert sum(i < toxic for i in got) == pytest.approx(min(toxic, (n - toxic) * 3 / 97), abs=12)
    assert toxic > 30 or sorted(got) == list(range(n))


def test_queries():
    names = set(llm.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert set(llm.oracle_sql()) <= names
    assert len(corpus_pipeline.STAGES) == 5


def test_near_dedup_decides_rows(spark, sf):
    """Rows of one id with texts of their own all stay; of equal and near texts, under whatever ids, one does."""
    docs = table(spark, sf, "documents").limit(0)
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(2) + " more"), (3, text(3)), (3, text(1) + " more"), (4, text(4))]
    df = spark.createDataFrame([(i, t, "en", s, 1) for s in ("b", "a") for i, t in rows], docs.schema)
    got = sorted((r.doc_id, r.text, r.source) for r in corpus_pipeline.near_dedup(spark, df, sf).collect())
    assert got == sorted([(1, text(1), "a"), (1, text(2), "a"), (3, text(3), "a"), (4, text(4), "a")])


def test_substring_dedup_keeps_blank_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    text = " ".join(f"w{k} is here." for k in range(40))
    df = spark.createDataFrame([(1, text, "en", "s", 9), (2, text, "en", "s", 9), (3, "", "en", "s", 9), (4, None, "en", "s", None), (5, " \n", "en", "s", 9)], docs.schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_dedup(spark, df, sf).collect()}
    assert got == {1: (text, len(text)), 3: ("", 0), 4: (None, None), 5: (" \n", 2)}


def test_whole_run_against_plain_stages(spark, sf, monkeypatch):
    """All documents of the smallest table through run(), and through stages of plain Python: the classifier's network a document
    at a time, all pairs, spans looked up by their words, and the library's encoder. The mixing stage decides on their output."""
    import hashlib

    import numpy as np
    import public_tokenizers
    import tiktoken
    from test_dedup import brute, spans_brute
    from tiktoken.load import load_tiktoken_bpe

    from fluxframe.llm import bpe, bytecnn

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(bpe.RANKS)), special_tokens={})

    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    model = bytecnn.trained(spark, table(spark, sf, "documents"), sf)
    scored = {d: bytecnn.probabilities(model, np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())]))[0] for d, r in docs.items()}
    ranked = sorted(scored.values())[20:60]  # a threshold that rejects some, between scores that are apart
    gap = max(range(len(ranked) - 1), key=lambda k: ranked[k + 1] - ranked[k])
    monkeypatch.setattr(bytecnn, "THRESHOLD", float(ranked[gap] + ranked[gap + 1]) / 2)
    good = [(d, r.text) for d, r in docs.items() if scored[d] >= bytecnn.THRESHOLD]
    first = {int(d) for d, _, _, kept in brute(good, 5) if kept}
    rest = [(d, t) for d, t in good if d in first]
    left = spans_brute([(d, t) for d, t in rest if t is not None])
    texts = {d: left.get(d) for d, t in rest if t is None or left[d].strip(" ") or not t.strip(" ")}
    schema = table(spark, sf, "documents").schema
    rows = [(d, t, docs[d].lang, docs[d].source, None if t is None else len(t)) for d, t in texts.items()]
    mixed = [r.doc_id for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows, schema), sf).collect()]
    want = []
    for d in mixed:
        ids = reference.encode_ordinary(texts[d] or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[d] or "").encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)
    assert len(texts) <= len(rest) < len(good) < len(docs)
