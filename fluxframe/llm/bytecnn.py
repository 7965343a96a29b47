"""A quality classifier: a byte-level convolutional network in numpy, trained here.

A text's UTF-8 bytes, padded with zeros to at least two blocks of BLOCK bytes, are embedded; filters slide over chunks of
two blocks, one block at a time, so that overlapping chunks cover the whole document; each filter's maximum over all
chunks of the document goes through one hidden layer into one probability. Long documents are scored strip by strip with
a running maximum: memory does not grow with them.

train() takes a bounded sample: of the labelled rows that the caller admits, the `sample` ones with the lowest hash of
their id, as far as their texts are of at most `most_bytes` bytes. That bound is a parameter; scoring has none.

Defined results: null and empty texts are scored as the padding alone; very long texts whole, one at a time; without any
usable label every score is 0.5; repeated rows get equal scores; labels of null are not used; ties of hashes are broken by
the id; an empty table gives no rows; the score's column replaces one of its name, whatever its case.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm.arrays import slices, text_bytes
from fluxframe.llm.tables import table, without

BLOCK, EMBED, FILTERS, HIDDEN = 4, 8, 48, 16
STRIP = 1 << 14
SAMPLE, MOST_BYTES = 4000, 1 << 16
THRESHOLD = 0.7

Model = dict[str, np.ndarray]


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes padded to whole blocks, as (blocks, BLOCK), and each row's first block."""
    sizes = np.diff(offsets)
    padded = np.maximum(2, -(-sizes // BLOCK)) * BLOCK
    starts = np.cumsum(padded) - padded
    out = np.zeros(int(padded.sum()), np.uint8)
    out[np.repeat(starts - offsets[:-1], sizes) + np.arange(len(data))] = data
    return out.reshape(-1, BLOCK), starts // BLOCK


def pooled(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each row's maximum of each filter."""
    n, half = len(data), BLOCK * EMBED
    out = np.full((len(starts), FILTERS), -np.inf, np.float32)
    last = np.zeros(n, bool)
    last[np.append(starts[1:], n) - 1] = True
    for lo in range(0, n - 1, STRIP):
        hi = min(lo + STRIP, n - 1)
        x = model["embed"][data[lo : hi + 1]].reshape(-1, half)
        y = x[:-1] @ model["filters"][:half]
        y += x[1:] @ model["filters"][half:]
        y[last[lo:hi]] = -np.inf  # these chunks would reach into the next row
        first = int(np.searchsorted(starts, lo, side="right")) - 1
        inner = starts[first + 1 : np.searchsorted(starts, hi)]
        got = np.maximum.reduceat(y, np.append(0, inner - lo), axis=0)
        np.maximum(out[first : first + len(got)], got, out=out[first : first + len(got)])
    return out


def _head(model: Model, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.tanh(pool + model["bias"])
    h = np.maximum(a @ model["hidden"] + model["hidden_bias"], 0)
    return a, h, 1 / (1 + np.exp(-np.clip(h @ model["out"] + model["out_bias"][0], -30, 30)))


def probabilities(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if model is None or not n:
        return np.full(n, 0.5)
    return _head(model, pooled(model, *blocks(data, offsets)))[2].astype(np.float64)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, seed: int = 7) -> Model | None:
    """A model of texts with labels 0 and 1 by Adam on the cross entropy; the gradient of a maximum goes to its chunk."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    half = BLOCK * EMBED
    y = np.asarray(labels, np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    model: Model = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 1 / np.sqrt(2 * half), (2 * half, FILTERS)),
        "bias": np.full(FILTERS, -1.0),
        "hidden": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)),
        "hidden_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, 0.1, HIDDEN),
        "out_bias": np.array([np.log(share / (1 - share))]),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            part = [texts[i] for i in rows]
            offsets = np.append(0, np.cumsum([len(t) for t in part]))
            data, starts = blocks(np.frombuffer(b"".join(part), np.uint8), offsets)
            ends = np.append(starts[1:], len(data))
            x = model["embed"][data].reshape(-1, half)
            z = x[:-1] @ model["filters"][:half]
            z += x[1:] @ model["filters"][half:]
            best = np.stack([a + z[a : b - 1].argmax(0) for a, b in zip(starts, ends, strict=True)])
            pool = z[best, np.arange(FILTERS)]
            a, h, p = _head(model, pool)
            g = (p - y[rows])[:, None] / len(rows)
            grads = {"out": h.T @ g[:, 0], "out_bias": g.sum(0)}
            gh = (g * model["out"]) * (h > 0)
            grads |= {"hidden": a.T @ gh, "hidden_bias": gh.sum(0)}
            gz = (gh @ model["hidden"].T) * (1 - a * a)
            grads["bias"] = gz.sum(0)
            chunk = np.concatenate([x[best], x[best + 1]], axis=2)
            grads["filters"] = np.einsum("dfk,df->kf", chunk, gz)
            back = (gz[:, :, None] * model["filters"].T).reshape(-1, 2 * BLOCK, EMBED)
            grads["embed"] = np.zeros_like(model["embed"])
            np.add.at(grads["embed"], np.concatenate([data[best], data[best + 1]], axis=2).reshape(-1), back.reshape(-1, EMBED))
            step += 1
            rate = 4e-3 * (1 - epoch / epochs) + 2e-4
            for k, d in grads.items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                model[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model | None:
    """A model from labelled (doc_id, label) and the documents' texts; at most sample texts of at most most_bytes each."""
    some = labelled.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    got = texts.filter(F.length("bytes") <= most_bytes).join(F.broadcast(some), "doc_id").orderBy("doc_id", "label", "bytes").limit(sample).collect()
    return fit([bytes(r["bytes"]) for r in got], np.array([r["label"] for r in got]))


def score(df: DataFrame, model: Model | None, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of df and, as `name`, its text's probability (double); no shuffle."""
    held = df.sparkSession.sparkContext.broadcast(model)  # 256 embeddings and FILTERS filters: about 30 KB
    columns = without(df.select(*columns), name)
    kept = df.select(*columns, *([] if "text" in columns else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        for batch in slices(batches, "text", 1 << 19):
            p = probabilities(held.value, *text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p)], names=[*columns, name])

    schema = df.select(*columns, F.lit(0.0).alias(name)).schema
    return kept.mapInArrow(run, schema)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 4: 2 marks rows held out of training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    labels = table(spark, sf_dir, "labels").filter(remainder() != 2)
    return train(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op6_bytecnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
