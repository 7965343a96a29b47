"""Every operator on tables whose other columns have the names that it uses, or adds."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fluxframe.llm import bpe, bytecnn, minhash, mixing, ogg, sharding, spans, tokenfiles, toolcalls, vafile
from fluxframe.llm.tables import fresh, new_path, without

NAMES = "score tokens posterior parts rate copies removed n_sentences shard slot ids decoded _id _rk _part key rk spans draw at part rank cuts bucket n before salt ways media call_id level u v m row mark blank copy c0 c3".split()
TEXT = " ".join(f"word{k} is here." for k in range(30))
ROWS = [(1, TEXT), (2, TEXT + " more"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "y")]


@pytest.fixture(scope="module", params=["text", "number"])
def crowded(spark, request):
    value = F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) if request.param == "text" else F.lit(777)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(value.alias(n.upper() if k % 5 == 4 else n) for k, n in enumerate(NAMES)))


def kept(df, crowded, *added):
    """The rows' own values, in all columns but those of the added names."""
    names = without(crowded, *added)
    left = [c for c in df.columns if c not in added]
    assert left == names
    return sorted(map(str, df.select(*(f"`{c}`" for c in names if c != "text")).collect())) == sorted(map(str, crowded.select(*(c for c in names if c != "text")).collect()))


def test_columns_stay(crowded, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    assert kept(mixing.mixed(crowded, labels, (0.5, 0.5), crowded.columns), crowded, *mixing.ADDED)
    assert kept(sharding.shard_rows(crowded), crowded, "shard", "slot")
    assert kept(spans.remove_repeats(crowded), crowded)
    assert kept(spans.remove_repeats(crowded, report=True), crowded, "n_sentences", "removed")
    assert kept(bytecnn.score(crowded, None, crowded.columns), crowded, "score")
    path = public_tokenizers.path(bpe.RANKS)
    encoded = bpe.encode(crowded, path)
    assert kept(encoded, crowded, "ids")
    assert kept(bpe.decode(encoded, path), crowded.drop("ids").withColumn("ids", F.lit(0)), "ids", "decoded") or bpe.decode(encoded, path).count() == len(ROWS)


def test_columns_do_not_matter(crowded, spark):
    plain = crowded.select("doc_id", "text")
    same = lambda f: sorted(map(str, f(crowded).collect())) == sorted(map(str, f(plain).collect()))
    assert same(lambda d: minhash.near_duplicates(d, 2))
    assert same(lambda d: bpe.round_trip(d, public_tokenizers.path(bpe.RANKS)))
    assert same(lambda d: ogg.features(ogg.with_media(d)))

    def files(d):
        out = new_path(spark, "names")
        return tokenfiles.read(spark, out, tokenfiles.write(d, public_tokenizers.path(tokenfiles.VOCABULARY), out))

    assert same(files)


def test_other_tables(spark):
    extra = [F.lit("own").alias(n) for n in NAMES if n not in ("call_id",)]
    vectors = spark.createDataFrame([(k, [k, 1]) for k in range(5)], "vec_id long, vector array<long>")
    assert vafile.search(vectors.select("*", *extra), lambda i: i == 0, 2).count() == 2
    embeddings = spark.createDataFrame([(k, [k / 2, 1.0]) for k in range(5)], "vec_id long, embedding array<float>")
    assert vafile.search(vafile.whole_numbers(embeddings.select("*", *extra)), lambda i: i == 0, 2).count() == 2
    calls = spark.createDataFrame([("a", "answer", '{"prompt":"p","turn":1}', None)], "call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([("a", "r")], "call_id string, content string")
    got = toolcalls.link(calls.select("*", *extra), results.select("*", *extra, F.lit(1).alias("status")), toolcalls.CHAT).collect()
    assert [(r.status, r.level, r.errors) for r in got] == [("linked", 0, [])]
    turns = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.chat_calls(turns.select("*", *extra, F.lit(True).alias("answered"))), toolcalls.CHAT).count() == 1


def test_fresh():
    assert fresh(["A", "b_", "C"], "a", "b", "b_", "c") == ["a_", "b", "b__", "c_"]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from fluxframe.llm.tables import table

    docs = table(spark, sf, "documents").select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES)).filter("doc_id < 120")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
