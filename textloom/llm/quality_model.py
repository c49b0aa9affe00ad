"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words; every passage of the whole text is encoded (shares of
letters, signs, digits and capitals, lengths, repetition, line breaks) and passed through a small
layer. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages; the weighted
passage representation is classified. All weights are learned together, from document labels only,
on a bounded sample of labelled rows outside the held-out fold (Adam, full gradients, fixed seed).

Edge cases: null and empty texts are one empty passage; without labels of both kinds all scores
are 0.5; repeated rows score alike; null doc_ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import chunks, words
from .common import documents, table
from .labelled import held_out, sample

FOLD_BY, FOLD_REST = 5, 0
THRESHOLD = 0.3
PASSAGE = 64
#: At most so many labelled rows are learned from; scoring covers all rows.
MOST_ROWS = 6000
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, SEED = 400, 0.02, 5


def _classes() -> np.ndarray:
    kind = np.zeros((6, 256), np.float64)
    kind[0, 65:91] = 1  # capitals
    kind[1, 97:123] = 1  # small letters
    kind[2, 48:58] = 1  # digits
    kind[3, [ord(c) for c in "#*$%&|<>=/\\{}[]_~^"]] = 1  # signs
    kind[4, [ord(c) for c in ".,;:!?'\""]] = 1  # punctuation
    kind[5, 128:] = 1  # beyond ASCII
    return kind


_KIND = _classes().astype(np.int64)


def passages(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk, and the first passage of each text."""
    start, end, h, at = words(buf, offs)
    n_words = np.diff(at)
    n = np.maximum((n_words + PASSAGE - 1) // PASSAGE, 1)
    first_of = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(first_of[-1]) - first_of[row]
    a = np.minimum(at[row] + k * PASSAGE, at[row + 1])
    b = np.minimum(a + PASSAGE, at[row + 1])
    m = b - a
    full = m > 0
    last = max(len(start) - 1, 0)
    lo = np.where(full, start[np.minimum(a, last)], 0) if len(start) else np.zeros(len(a), np.int64)
    hi = np.where(full, end[np.clip(b - 1, 0, last)], 0) if len(start) else np.zeros(len(a), np.int64)
    size = np.maximum(hi - lo, 1).astype(float)

    def summed(x: np.ndarray, lo, hi) -> np.ndarray:
        total = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x, out=total[1:])
        return (total[hi] - total[lo]).astype(float)

    cols = [summed(kind[buf], lo, hi) / size for kind in _KIND]
    lines = summed(buf == 10, lo, hi)
    length = end - start
    some = np.maximum(m, 1)
    mean = summed(length, a, b) / some
    again, near = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    # a word seen before in its passage
    order = np.lexsort((h, np.repeat(np.arange(len(a)), m))) if len(h) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(a)), m)
    near[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    cap = np.zeros(len(h), bool) if not len(h) else (buf[end - 1] == 33) | ((buf[start] >= 65) & (buf[start] <= 90) & (length > 1) & (buf[np.minimum(start + 1, len(buf) - 1)] >= 65) & (buf[np.minimum(start + 1, len(buf) - 1)] <= 90))
    cols += [mean / 10, summed(length * length, a, b) / some / 100, summed(length == 1, a, b) / some, summed(length > 14, a, b) / some, summed(again, a, b) / some, summed(near, a, b) / some, summed(cap, a, b) / some, lines / some, np.log1p(m), m / PASSAGE, np.log1p(n_words[row]), (n_words[row] < 20).astype(float)]
    x = np.column_stack(cols)
    x[~full] = 0
    return x, first_of


N_FEATURES = 18


def forward(model: dict, x: np.ndarray, first: np.ndarray) -> tuple:
    """Probabilities of the bags whose passages begin at ``first``."""
    z = (x - model["mean"]) / model["std"]
    h = np.tanh(z @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (t * g) @ model["w"]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top = np.maximum.reduceat(e, first[:-1])
    s = np.exp(e - top[row])
    a = s / np.add.reduceat(s, first[:-1])[row]
    bag = np.add.reduceat(a[:, None] * h, first[:-1])
    logit = bag @ model["c"] + model["d"]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (z, h, t, g, a, row, bag)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS) -> dict | None:
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    model = {"mean": x.mean(0), "std": x.std(0) + 1e-3, "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
    keys = ["W", "b", "V", "U", "w", "c", "d"]
    m1, m2 = ({k: np.zeros_like(model[k]) for k in keys} for _ in range(2))
    for step in range(1, steps + 1):
        p, (z, h, t, g, a, row, bag) = forward(model, x, first)
        dl = (p - y) / len(y)
        dbag = dl[:, None] * model["c"]
        da = (dbag[row] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first[:-1])[row])
        dt, dg = de[:, None] * model["w"] * g * (1 - t * t), de[:, None] * model["w"] * t * g * (1 - g)
        dh = (a[:, None] * dbag[row] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
        grad = {"W": z.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": bag.T @ dl, "d": np.array([dl.sum()])}
        for k in keys:
            gk = grad[k] + 1e-4 * model[k]
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
            model[k] = model[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict | None:
    rows = sample(docs, labels, "quality", FOLD_BY, FOLD_REST, most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, done = batch.column(2).to_numpy(), 0
            for ids, buf, offs in chunks(batch):
                x, first = passages(buf, offs)
                bags = [x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y[done : done + len(ids)]), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])
                done += len(ids)

    got = rows.mapInArrow(encode, "doc_id long, y int, bag binary").orderBy("doc_id", "bag").collect()  # features of at most ``most`` rows
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES).astype(float) for r in got]
    if not bags:
        return None
    return train(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, buf, offs in chunks(batch):
                x, first = passages(buf, offs)
                out.append(forward(model, x, first)[0] if model else np.full(len(first) - 1, 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(read, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLD_BY, FOLD_REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
