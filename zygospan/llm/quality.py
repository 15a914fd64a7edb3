"""Quality scores by naive Bayes support vectors.

Byte n-gram indicators are scaled by the log ratio of their class counts and brought to unit length; a hinge-loss linear
model is fitted by dual coordinate descent, and a logistic curve over rows it did not see turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import column, sigmoid, small_batches

SAMPLE = 6000
BITS = 18
ORDERS = (2, 3, 4)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def grams(text: str | None, flags: np.ndarray, orders=ORDERS, bits: int = BITS, step: int = 1 << 20) -> np.ndarray:
    """Sorted hashed n-grams that occur in the whole text; ``flags`` is scratch space of ``2^bits`` falses."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    for k in orders:
        for a in range(0, max(0, len(raw) - k + 1), step):
            part = raw[a : a + step + k - 1].astype(np.uint32)
            n = len(part) - k + 1
            h = np.full(n, k, dtype=np.uint32)
            for j in range(k):
                h = (h ^ part[j : j + n]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            flags[h >> np.uint32(32 - bits)] = True
    found = np.flatnonzero(flags).astype(np.int32)
    flags[found] = False
    return found


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss support vector machine with a bias feature, by coordinate descent on the dual."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norms = np.array([v @ v for v in values]) + 1.0
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[rows[i]] += d * values[i]
                bias += d
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; ``x`` includes its constant column."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ b)
        grad = x.T @ (p - y) + ridge * b
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        move = np.linalg.solve(hess, grad)
        size = np.abs(move).max()
        b -= move * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return b


def fit(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> Model:
    """Fit on four fifths of the rows and calibrate on the rest; one class alone gives a constant score."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 0.0, 4.0 if len(y) and y[0] == 1 else -4.0 if len(y) else 0.0)
    test = np.arange(len(y)) % 5 == 4
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test = np.zeros(len(y), dtype=bool)
    p, q = np.full(size, smooth), np.full(size, smooth)
    for i in np.flatnonzero(~test):
        (p if y[i] == 1 else q)[rows[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())

    def scaled(r):
        v = ratio[r]
        n = np.sqrt(v @ v)
        return v / n if n else v

    values = [scaled(r) for r in rows]
    train_ix = np.flatnonzero(~test)
    w, bias = dual_descent([rows[i] for i in train_ix], [values[i] for i in train_ix], np.where(y[train_ix] == 1, 1.0, -1.0), size)
    use = test if test.any() else ~test
    margins = np.array([w[rows[i]] @ values[i] + bias for i in np.flatnonzero(use)])
    slope, shift = logistic(np.c_[margins, np.ones(len(margins))], (y[use] == 1).astype(float), ridge=0.1)
    return Model(np.stack([w, ratio]), bias, float(slope), float(shift))


def train(docs: DataFrame, rows: DataFrame, bits: int = BITS, orders=ORDERS) -> Model:
    """Fit on ``rows`` (``doc_id, y``), a bounded sample: at most ``SAMPLE`` labelled ids by default.

    The sample is small by that bound, so it is broadcast and its n-grams meet in one task. Equal texts teach once.
    """
    size = 1 << bits

    def extract(batches):
        flags = np.zeros(size, dtype=bool)
        for batch in small_batches(batches):
            found = [grams(t, flags, orders, bits).tobytes() for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "y"), pa.int32()), pa.array(column(batch, "x"), pa.int64()), pa.array(found, pa.binary())], ["y", "x", "found"])

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(table["x"].to_numpy(), kind="stable")
        y, found = table["y"].to_numpy()[order], table["found"].to_pylist()
        m = fit([np.frombuffer(found[i], dtype=np.int32) for i in order], y, size)
        return pa.table({"w": pa.array([m.weights.astype(np.float64).tobytes()], pa.binary()), "b": [[m.bias, m.slope, m.shift]]})

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(rows), "doc_id")
    texts = texts.select("y", F.xxhash64("text").alias("x"), "text").mapInArrow(extract, "y int, x long, found binary")
    one = texts.groupBy("x").agg(F.max("y").alias("y"), F.first("found").alias("found"))
    got = one.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "w binary, b array<double>").head()
    if got is None:
        return Model(np.zeros(size), 0.0, 0.0, 0.0)
    w = np.frombuffer(got.w, dtype=np.float64)
    return Model(w.reshape(2, -1) if len(w) == 2 * size else w, *got.b)


def score(docs: DataFrame, model: Model, bits: int = BITS, orders=ORDERS) -> DataFrame:
    """``doc_id, score`` per row: higher means label 1 is likelier.

    Empty and null texts have no n-gram and get the score of the bias alone; without labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, flags = shared.value, np.zeros(1 << bits, dtype=bool)
        flat = m.weights.ndim == 1
        gain, power = (None, None) if flat else (m.weights[0] * m.weights[1], m.weights[1] ** 2)
        for batch in small_batches(batches):
            out = []
            for text in column(batch, "text"):
                found = grams(text, flags, orders, bits)
                norm = 0.0 if flat else np.sqrt(power[found].sum())
                out.append(m.bias + (gain[found].sum() / norm if norm else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(m.slope * np.array(out) + m.shift), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
