"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table predicts each document's posterior over domains. Then rates r >= 0, the expected
copies of each document, are fitted so that the expected tokens of each domain, sum of tokens * r * posterior, match the
targets, by least squares.

The fit is a projected gradient method over all documents. The error of the totals, e, gives a document the gradient
posterior * M e, with a metric M of K x K numbers, so all steps of a document are one product of its posterior and the sum
of the steps, g: its rate is max(0, 1 - posterior * g), the projection of where the steps have led from 1. The state of
the method is g, K numbers; an iteration is one distributed pass over the table of posteriors that adds up, for several step
lengths at once, each domain's total, the K x K second moments of the documents whose rate is not 0 (the next metric), and
the loss; tasks return one row of such sums each partition, which are added up before the driver takes the best length. With
the metric of the rates that are not 0, few passes are needed even where many rates are 0. Of all rates that reach the
targets the method finds those nearest to 1, by tokens. A weight RIDGE on the steps keeps them finite where targets are out
of reach: then it ends at the nearest totals in the norm of the inverse second moments, the least squares solution. A fit
that does not reach TOLERANCE of all tokens in `iterations` passes warns, with its error, and is taken as it is.

Memory: batches of the table; K squared sums for each step length. Nothing grows with the corpus but the table of posteriors.

Defined results: a null or empty text has no tokens, and its rate follows its posterior like any other's; very long texts
count whole, one at a time; without labels every posterior is even; a domain without any mass can't match its target, and
the fit is the nearest in least squares; repeated rows have equal rates, and draws of their own only if something in (doc_id,
text) differs; an empty table gives no rows; ties need no rule; the added columns tokens, posterior, rate and copies replace
columns of those names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm.arrays import LOWER, U64, RangeHash, slices, text_bytes, words
from fluxframe.llm.tables import at, fresh, keep, table, without

BUCKETS, SAMPLE, MOST_BYTES = 2048, 4000, 1 << 16
ITERATIONS, TOLERANCE, RIDGE = 60, 1e-7, 1e-9
#: Step lengths of one pass.
LENGTHS = tuple(2.0**-k for k in range(8))
DOMAINS = ("bad", "bad toxic", "good", "good toxic")
WEIGHTS = (0.12, 0.02, 0.8, 0.06)
ADDED = ("tokens", "posterior", "rate", "copies")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row log counts of hashed words, shares of kinds of bytes and 1; and its number of words."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    bucket = (RangeHash(LOWER[data])(start, end) % U64(BUCKETS)).astype(np.int64)
    counts = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = counts.sum(1)
    kinds = np.zeros(256, np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*@", b"\n"), 1):
        kinds[list(chars)] = k
    owner = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(owner * 8 + kinds[data], minlength=n * 8).reshape(n, 8)[:, 1:] / np.maximum(1, np.diff(offsets))[:, None]
    x = np.concatenate([np.log1p(counts), np.sqrt(shares) * 8, np.ones((n, 1))], axis=1)
    return x.astype(np.float32), total


def fit_posteriors(texts: list[bytes], labels: np.ndarray, k: int, steps: int = 200) -> np.ndarray | None:
    """Weights of a softmax regression by Adam over all of a bounded sample."""
    if not texts:
        return None
    x = np.concatenate([features(np.frombuffer(b"".join(part), np.uint8), np.append(0, np.cumsum([len(t) for t in part])))[0] for part in (texts[i : i + 256] for i in range(0, len(texts), 256))])
    y = np.eye(k, dtype=np.float32)[labels]
    w = np.zeros((x.shape[1], k), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (_softmax(x @ w) - y) / len(x) + 1e-4 * w
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, k: int, sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> np.ndarray | None:
    """Weights from labelled (doc_id, label from 0 to k - 1): the `sample` rows of lowest hash, texts of at most most_bytes."""
    some = labelled.filter(F.col("doc_id").isNotNull() & F.col("label").between(0, k - 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    got = texts.filter(F.length("bytes") <= most_bytes).join(F.broadcast(some), "doc_id").orderBy("doc_id", "label", "bytes").limit(sample).collect()
    return fit_posteriors([bytes(r["bytes"]) for r in got], np.array([r["label"] for r in got], np.int64), k)


def with_posteriors(docs: DataFrame, weights: np.ndarray | None, k: int, columns: list[str]) -> DataFrame:
    """The given columns (none is named tokens or posterior), tokens (long: words), posterior (array<double>)."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS rows of k weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            for lo in range(0, batch.num_rows, 512):  # 512 rows of BUCKETS counts at once
                part = batch.slice(lo, 512)
                x, tokens = features(*text_bytes(part.column("text")))
                p = _softmax((x @ held.value).astype(np.float64)) if held.value is not None else np.full((len(x), k), 1 / k)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(tokens.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))], names=[*columns, "tokens", "posterior"])

    schema = docs.select(*columns, F.lit(0).cast("long").alias("tokens"), F.array(F.lit(0.0)).alias("posterior")).schema
    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(run, schema)


def rates(posteriors: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - posteriors @ g)


def sums(predicted: DataFrame, k: int, steps: np.ndarray) -> np.ndarray:
    """For each g of steps, over all rows of predicted (tokens, posterior): tokens * rate ** 2, the domains' totals, and the
    k * k second moments where the rate is not 0. One row a partition leaves the scan; these are added up by number."""
    steps = np.asarray(steps, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(steps), 1 + k + k * k))
        for batch in batches:
            w = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            for line, g in zip(out, steps, strict=True):
                r = rates(p, g)
                wr = w * r
                line[0] += wr @ r
                line[1 : k + 1] += wr @ p
                line[k + 1 :] += ((p * np.where(r > 0, w, 0)[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_pydict({"place": np.arange(out.size), "value": out.ravel()})

    got = predicted.select("tokens", "posterior").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((len(steps), 1 + k + k * k))
    for r in got:  # len(steps) * (1 + k + k * k) numbers
        out.flat[r["place"]] = r["value"]
    return out


def fit_rates(predicted: DataFrame, weights: list[float], total: float | None = None, iterations: int = ITERATIONS) -> np.ndarray:
    """g of the rates max(0, 1 - posterior * g) of predicted (tokens, posterior), whose totals match weights * total (the
    corpus's tokens if None). Warns if they are not within TOLERANCE after so many passes."""
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    g = np.zeros(k)
    now = sums(predicted, k, g[None])[0]
    n = now[1 : k + 1].sum()
    if not n:
        return g
    target = share * (n if total is None else total) / n
    every = now[k + 1 :].reshape(k, k) / n
    ridge = RIDGE * every + 1e-15 * np.eye(k)
    # The dual of the projected least squares: convex in g, with the error of the totals as its gradient.
    loss = lambda line, g: line[0] / n / 2 + target @ g + g @ ridge @ g / 2
    error = lambda line, g: target - line[1 : k + 1] / n + ridge @ g
    for _ in range(iterations):
        e = error(now, g)
        if np.abs(e).max() <= TOLERANCE:
            return g
        metric = now[k + 1 :].reshape(k, k) / n + ridge
        step = -np.linalg.lstsq(metric, e, rcond=1e-15)[0]
        tried = g + np.outer(LENGTHS, step)
        lines = sums(predicted, k, tried)
        losses = [loss(a, b) for a, b in zip(lines, tried, strict=True)]
        best = int(np.argmin(losses))
        full = np.abs(error(lines[0], tried[0])).max()
        if full <= TOLERANCE or losses[best] >= loss(now, g) and full < np.abs(e).max():
            best = 0  # so near the end that the loss can't tell
        elif losses[best] >= loss(now, g):
            tried, lines = g + np.outer(np.array(LENGTHS) * LENGTHS[-1] / 2, step), None
            lines = sums(predicted, k, tried)
            best = int(np.argmin([loss(a, b) for a, b in zip(lines, tried, strict=True)]))
        g, now = tried[best], lines[best]
    warnings.warn(f"mixing: the totals are {np.abs(error(now, g)).max():.3g} of all tokens from the fit's after {iterations} passes", stacklevel=2)
    return g


def rate_of(posterior, g: np.ndarray):
    """The rate of a column of posteriors."""
    dot = F.aggregate(F.zip_with(posterior, F.array(*[F.lit(float(x)) for x in g]), lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(0.0), 1 - dot)


def mixed(docs: DataFrame, labelled: DataFrame, weights: tuple[float, ...], columns: list[str], total_of: float = 1.0, seed: int = 5, once: int | None = None, at_most: int | None = None) -> DataFrame:
    """The given columns of docs, tokens, posterior, rate (double) and copies (int: rate rounded up or down by a hash of the
    row, so that its expectation is the rate). total_of scales the target's sum against the corpus's tokens; with once, a
    domain's number, rates are scaled after the fit so that the document nearest to that domain has the rate 1. With at_most,
    that domain's weight is an upper bound: where its share is below, the target is the share, and the others' weights grow."""
    k, names = len(weights), without(docs.select(*columns), *ADDED)
    (draw,) = fresh([*docs.columns, *ADDED], "draw")
    rows = docs.withColumn(draw, F.xxhash64(F.lit(seed), "doc_id", "text"))
    predicted = with_posteriors(rows, train(docs, labelled, k), k, [*names, draw])
    predicted = at(docs.sparkSession, keep(predicted, "posteriors"), predicted)
    if at_most is not None:
        totals = sums(predicted, k, np.zeros((1, k)))[0, 1 : k + 1]
        share, rest = totals / max(totals.sum(), 1.0), sum(weights) - weights[at_most]
        if 0 < totals.sum() and share[at_most] * sum(weights) < weights[at_most]:
            weights = tuple(float(share[at_most]) if i == at_most else float((1 - share[at_most]) * w / rest) for i, w in enumerate(weights))
    g = fit_rates(predicted, list(weights), None if total_of == 1.0 else (predicted.agg(F.sum("tokens")).first()[0] or 0) * total_of)
    scale = 1.0
    if once is not None:
        purest = predicted.agg(F.max(F.struct(F.col("posterior")[once].alias("p"), "posterior")).alias("m")).first()["m"]
        scale = rates(np.array([purest["posterior"]]), g)[0] if purest else 1.0
    rate = rate_of(F.col("posterior"), g) / F.lit(float(scale) if scale > 0 else 1.0)
    part = F.pmod(F.col(draw), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return predicted.select(*names, "tokens", "posterior", rate.alias("rate"), F.floor(rate + part).cast("int").alias("copies"))


def by_domain(labels: DataFrame) -> DataFrame:
    """doc_id and label: the place in DOMAINS of the labels' quality and toxicity."""
    return labels.select("doc_id", (2 * F.col("quality") + F.col("toxic")).alias("label"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), by_domain(table(spark, sf_dir, "labels")), WEIGHTS, ["doc_id"])
    shares = [F.col("posterior")[i].alias("p_" + d.replace(" ", "_")) for i, d in enumerate(DOMAINS)]
    return out.select("doc_id", "tokens", *shares, "rate", "copies")
