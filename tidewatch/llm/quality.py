"""Quality classifier on learned subword embeddings.

Words and character n-grams are hashed into one table of learned vectors; a
document is the mean of its vectors, a softmax gives the class.  Training is
numpy stochastic gradient descent in one task over a bounded, documented sample
of labelled rows (``TRAIN_ROWS``, taken by a hash of doc_id); scoring is a narrow
pass over all documents.  For scoring, the product of table and output layer is
folded into one number per bucket, which is exact as the model is linear there.

A step is divided by one plus the squared norms of the vector and of the output
layer it meets, so no step moves a document's own logit by more than
``RATE``; a model that is not finite is refused.

Scale: the model (``BUCKETS`` numbers) is all that is shipped; its size does not
depend on the data.  Labels join documents by doc_id for the sampled ids only.
The training task turns each text of the sample into at most ``BUCKETS`` numbers
as it reads it.

Defined results: a null text is empty; an empty text has the score of the bias
alone; without labelled rows, or with one class only, the score is the prior
(0.5 without rows); a doc_id labelled more than once counts as 1 if any label
is 1; null doc_ids are scored, never learned from; repeated rows repeat; an empty
table gives no rows; columns of any other name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _text
from ._spark import annotate, small_batches, tidy

TRAIN_ROWS = 6000  # most labelled rows to learn from
BUCKETS = 1 << 16
GRAMS = (3, 4)  # bytes of a character n-gram
DIMS = 8
EPOCHS = 6
LEAST_STEPS = 6000  # a small sample is read more often, until so many steps are made
RATE = 1.0
_SEED = 7


def _buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all rows, and each feature's row."""
    low = _text.LOWER[data]
    starts, ends, first = _text.words(low, offs, _text.NOT_SPACE)
    parts = [(_text.hash_words(low, starts, ends) >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1)]
    rows = [np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(first))]
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    wide = low.astype(np.uint32)
    for n in GRAMS:
        if len(low) < n:
            continue
        h = np.full(len(low) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ wide[k : k + len(h)]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inside = row[: len(h)] == row[n - 1 :]
        parts.append((h[inside] * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int32) & (BUCKETS - 1))
        rows.append(row[: len(h)][inside])
    return np.concatenate(parts), np.concatenate(rows)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares."""
    ids, n = np.unique(_buckets(*_text.flat(pa.array([text], pa.string())))[0], return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Folded model: a logit per bucket, then the bias."""
    model = np.zeros(BUCKETS + 1)
    y = np.array(labels, float)
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return model
    rng = np.random.default_rng(_SEED)
    table = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out = np.zeros((2, DIMS), np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # classes weigh alike while learning
    weight = np.minimum(weight / weight.mean(), 4.0)
    spread = np.array([1 / max(float((w * w).sum()), 1e-6) for _, w in bags])
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(y)))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, w = bags[i]
            rate = min(1.0, RATE * (1 - done / steps) * weight[i])
            done += 1
            if not len(ids):
                continue
            hidden = w @ table[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = p @ out
            rate /= 1 + float(hidden @ hidden) + float((out * out).sum())
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            # the mean spreads a gradient over all features: ``spread`` makes the mean itself move by ``rate * back``
            table[ids] -= (rate * spread[i]) * w[:, None] * back[None, :]
    model[:-1] = table @ (out[1] - out[0])
    model[-1] = bias[1] - bias[0]
    if not np.isfinite(model).all():
        raise FloatingPointError("the quality model is not finite")
    return model


def score_slice(data: np.ndarray, offs: np.ndarray, model: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    bucket, row = _buckets(data, offs)
    total = np.bincount(row, weights=model[bucket], minlength=n)
    count = np.bincount(row, minlength=n)
    z = total / np.maximum(count, 1) + model[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Model from at most ``rows`` labelled documents outside the held-out third."""
    small_batches(docs)
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marks.withColumn("turn", F.xxhash64("doc_id", F.lit(_SEED))).orderBy("turn", "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    # a doc_id may repeat in the documents: the bound holds for rows, too
    sample = sample.withColumn("place", F.xxhash64("text")).orderBy("turn", "doc_id", "place").limit(rows).select("text", "quality", "turn", "doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for i in range(b.num_rows):
                text, quality, turn, doc_id, place = (b.column(k)[i].as_py() for k in range(5))
                held.append((turn, doc_id, place, int(quality > 0), bag(text)))
        held.sort(key=lambda r: r[:4])
        model = train([r[4] for r in held], [r[3] for r in held])
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.astype(np.float64).tobytes()], pa.binary())})

    got = sample.coalesce(1).mapInArrow(tidy(run), "model binary").collect()
    return np.frombuffer(bytes(got[0][0])) if got else train([], [])


def score(docs: DataFrame, model: np.ndarray, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned) holding ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shipped.value
        return lambda part: {"score": score_slice(*_text.flat(part.column(0)), m)}

    return annotate(docs, kernel, StructType([StructField("score", DoubleType())]), keep, limit=1 << 20)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier does not reject, with their own columns."""
    df, f = score(docs, fit(docs, labels))
    return df.filter(F.col(f)["score"] >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    df, f = score(docs, fit(docs, labels), keep=["doc_id"])
    s = F.col(f)["score"]
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
