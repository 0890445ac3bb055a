"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused
from .textops import mix64, prefix_hash, runs, seeded, string_buffers, window_hash, words

GROUPS = 4  # words, pairs of words, character trigrams, character 5-grams


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum over feature groups of the mean of table[feature]).

    With two classes and averaged vectors, output row 1 minus row 0 times a vector is all that a feature adds, so scoring
    needs one number for each hashed feature.
    """

    table: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group: the hashed features of documents laid end to end and the n + 1 offsets of the documents.

    A word that repeats the one before it makes the same pair feature whatever the word.
    """
    h, _, _, first = words(data, offsets, lower=False)
    shift, salt = np.uint64(64 - bits), seeded(23, GROUPS)
    at = lambda x, g: (mix64(x ^ salt[g]) >> shift).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = np.where(h[1:] == h[:-1], np.uint64(1), mix64(h[:-1]) + h[1:])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = doc[1:] == doc[:-1]
    inner = np.concatenate(([0], np.cumsum(inside)))
    out = [(at(h, 0), first), (at(pair[inside], 1), inner[np.maximum(first - (first > 0), 0)] if len(h) else first)]
    prefix = prefix_hash(seeded(29, 256)[data])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for g, n in ((2, 3), (3, 5)):
        m = max(0, len(data) - n + 1)
        start = np.arange(m)
        ok = owner[:m] == owner[n - 1 :] if m else np.zeros(0, dtype=bool)
        f = at(window_hash(prefix, start, start + n), g)[ok]
        out.append((f, np.concatenate(([0], np.cumsum(ok)))[np.minimum(offsets, m)]))
    return out


def scores(model: Model, column) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    data, off = string_buffers(column)
    out = np.full(len(off) - 1, model.bias)
    bits = int(len(model.table)).bit_length() - 1
    for i, j in runs(off):
        for f, first in features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits):
            total = np.concatenate(([0.0], np.cumsum(model.table[f], dtype=np.float64)))
            n = np.diff(first)
            out[i:j] += np.where(n > 0, (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1), 0.0)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[str], labels: list[int], bits: int = 18, dim: int = 8, epochs: int = 5, rate: float = 1.0, seed: int = 1) -> Model:
    """Trains by stochastic gradient descent, a document at a time, with a falling rate.  No rows: every score is 0.5."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((2, dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    rows = []
    data, off = string_buffers(pa.array(texts, pa.large_string()))
    for i, j in runs(off):
        groups = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
        for d in range(j - i):
            ids, weights = [], []
            for f, first in groups:
                own, n = np.unique(f[first[d] : first[d + 1]], return_counts=True)
                ids.append(own)
                weights.append(n / max(1, n.sum()))
            ids, weights = np.concatenate(ids), np.concatenate(weights).astype(np.float32)
            ids, back = np.unique(ids, return_inverse=True)
            rows.append((ids.astype(np.int32), np.bincount(back, weights, len(ids)).astype(np.float32)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, weight = rows[r]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            v = weight @ e[ids]
            z = w @ v + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[r]] -= 1
            back = p @ w
            w -= lr * np.outer(p, v)
            b -= lr * p * np.float32(0.1)
            e[ids] -= (lr * weight)[:, None] * back
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 2000, sample_bytes: int = 16384, folds: int = 5) -> Model:
    """Fits on a bounded sample: the `sample_rows` labelled rows with the least hash of their id, of those whose
    crc32(doc_id as text) mod `folds` is not 0, and whose text has at most `sample_bytes` bytes.  Both bounds hold for
    training alone; rows with a null id or label are not used."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (key % folds != 0))
    own = own.select("doc_id", F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    rows = sorted(texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text").collect())
    return fit([r.text for r in rows], [int(r.label > 0) for r in rows])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` of every row, score (0 to 1) and predicted (1 if score >= threshold, else 0), under `names`.

    Scores come from the text alone.  Null and empty texts have no features and score as the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**bits bytes, whatever the input
    fields = [f for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(shared.value, batch.column(len(fields)))
            more = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *more], [*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], T.DoubleType()).add(names[1], T.IntegerType())
    return docs.select(*keep, F.col("text").alias(unused(docs, "of"))).mapInArrow(run, schema)
