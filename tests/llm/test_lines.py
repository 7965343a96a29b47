"""Line dedup against brute force, and its levelled runs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxframe.llm import lines

INK = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(INK))


def brute(rows, least):
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if count[key(x)] < least]
        out.append((str(d), len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = [rng.choice(["Home", "home ", "\tABOUT us\r", "Ümlaut", "ümlaut", "a ", " ", "", " \x0b ", "x" * rng.randint(1, 300)]) + rng.choice(["", "", str(rng.randint(0, 40))]) for _ in range(60)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "\nHome\n"), (None, "Home"), (0, rows[0][1]), (0, rows[0][1]), (n + 4, "home\n" * 500 + "only here"), (n + 5, "one line")]


@pytest.mark.parametrize("seed, least, batches, parts, hot", [(1, 10, 3, 5, 4096), (2, 3, 2, 4, 0), (3, 2, 1, 2, 3)])
def test_brute_force(spark, docs_of, monkeypatch, seed, least, batches, parts, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rows = corpus(seed)
    got = lines.drop_lines(docs_of(rows).repartition(parts), least, batches, report=True)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows, least)


def test_hot_row_and_line(spark, docs_of):
    rows = [(7, "hot\nown line")] * 300 + [(k, f"hot\n{k}\nrare") for k in range(100, 109)]
    got = lines.drop_lines(docs_of(rows), report=True)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows, 10)


def test_empty_and_columns(spark, docs_of):
    assert lines.drop_lines(docs_of([(1, "a")]).filter("false"), report=True).collect() == []
    names = ["rk", "lost", "H", "n_lines", "batch", "n", "m"]
    docs = spark.createDataFrame([(k, "same\nline " + str(k)) for k in range(12)], "doc_id long, text string").select("*", *(F.concat(F.lit("own"), F.col("doc_id").cast("string")).alias(n) for n in names))
    out = lines.drop_lines(docs)
    assert out.dtypes == docs.dtypes
    assert all(r.text == f"line {r.doc_id}" and r.rk == r.lost == r.n == f"own{r.doc_id}" for r in out.collect())


def test_runs(spark):
    """A binary counter of levels, keys settled by one run not added by the next, runs merged without an exchange."""
    runs = lines.Runs(spark, 4)
    batch = lambda *n: spark.createDataFrame([(bytes([k]), x) for k, x in enumerate(n)], "h binary, n long")
    sizes = []
    for _ in range(5):
        runs.add(batch(4, 1, 2))
        sizes.append([None if name is None else spark.table(name).count() for name in runs.levels])
    assert sizes == [[3], [None, 3], [1, 3], [None, None, 3], [0, None, 3]]  # settled: key 0, then 0 and 2, then all three
    assert sorted(bytes(r.h) for r in runs.settled().collect()) == [b"\0", b"\1", b"\2"]
    merged = runs._merged(*(spark.table(n) for n in runs.levels if n))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merged and "Exchange" not in merged
    runs.close()
    assert runs.settled().collect() == []
