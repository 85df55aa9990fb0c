"""Toxicity: logistic regression trained by FTRL-proximal over hashed word features.

Features of a document are the *set* of its hashed words, adjacent word pairs and pairs
with one word between (skip-grams).  Training follows the published FTRL-proximal rule:
per-coordinate learning rates and L1 shrinkage, so few weights are non-zero and the model
that travels to the executors is small whatever the corpus.

Defined results: a null or empty text has no features, so its score is that of the bias;
it is toxic only if the bias alone passes the threshold.  Labels that are null are left
out; without any labelled row every score is 0.5 and nothing is toxic.  Rows that repeat
are scored alike.  Extra columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textkernel import Words, mix, slices

#: FTRL-proximal settings; ``max_train_rows`` bounds the labelled sample the model is fit on.
PARAMS = {"bits": 20, "alpha": 0.3, "beta": 1.0, "l1": 10.0, "l2": 1.0, "epochs": 4, "max_train_rows": 20_000, "holdout": 0.2}

_A, _B, _C = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC3A5C85C97CB3127), np.uint64(0xB492B66FBE98F273)


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float
    bits: int
    #: precision and recall on the held-out labelled rows
    precision: float
    recall: float


def features(rows: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature index and row of every occurrence, and the number of rows."""
    w = Words(rows)
    h, r = w.hash, w.row
    idx, row = [h], [r]
    for gap, factor in ((1, _B), (2, _C)):
        if len(h) > gap:
            same = np.flatnonzero(r[:-gap] == r[gap:])
            idx.append(mix(h[same] * _A + h[same + gap] * factor))
            row.append(r[same])
    return (np.concatenate(idx) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(row), w.rows


def feature_sets(rows: pa.Array, bits: int) -> list[np.ndarray]:
    idx, row, n = features(rows, bits)
    key = np.unique((row << bits) | idx)
    cut = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits)
    key &= (1 << bits) - 1
    return [key[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_sets(sets: list[np.ndarray], labels: np.ndarray, p: dict) -> dict:
    """FTRL-proximal over the examples in order; the last share is held out for the threshold."""
    size = 1 << p["bits"]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    cut = len(sets) - int(len(sets) * p["holdout"]) if len(sets) >= 20 else len(sets)

    def weights(idx):
        zi, root = z[idx], np.sqrt(n[idx])
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(idx == size, 0.0, p["l1"]), 0.0)
        return -shrunk / ((p["beta"] + root) / p["alpha"] + p["l2"]), root

    for _ in range(p["epochs"]):
        for s, y in zip(sets[:cut], labels[:cut]):
            idx = np.append(s, size)
            w, root = weights(idx)
            g = float(_sigmoid(w.sum())) - y
            n[idx] += g * g
            z[idx] += g - (np.sqrt(n[idx]) - root) / p["alpha"] * w
    every, _ = weights(np.arange(size + 1))
    held = range(cut, len(sets)) if cut < len(sets) else range(len(sets))
    score = np.array([_sigmoid(every[sets[i]].sum() + every[size]) for i in held])
    truth = labels[list(held)].astype(bool)
    best = (-1.0, 0.5, 0.0, 0.0)
    for t in np.linspace(0.1, 0.9, 33):
        hit = score >= t
        tp = float((hit & truth).sum())
        pr, rc = tp / max(1, hit.sum()), tp / max(1, truth.sum())
        f = 1.25 * pr * rc / max(1e-12, 0.25 * pr + rc)  # F0.5: clean documents should stay
        if (f, -abs(t - 0.5)) > (best[0], -abs(best[1] - 0.5)):
            best = (f, float(t), pr, rc)
    index = np.flatnonzero(every[:size])
    return {"index": index, "weight": every[index], "bias": float(every[size]), "threshold": best[1], "precision": best[2], "recall": best[3]}


def fit(docs: DataFrame, labels: DataFrame, **params) -> Model:
    """Fit on at most ``max_train_rows`` labelled rows, chosen by a hash of doc_id.

    One task trains, so the examples are never gathered on the driver; only the non-zero
    weights come back.
    """
    p = PARAMS | params
    chosen = (
        labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y"))
        .dropna()
        .withColumn("o", F.xxhash64("i"))
        .orderBy("o", "i", "y")
        .limit(p["max_train_rows"])
    )
    # At most max_train_rows rows of 20 bytes: a bounded broadcast.
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).join(F.broadcast(chosen), "i")

    def train(batches):
        # one example of each text and label: copies shouldn't outvote the rest
        sets, ys, seen = [], [], set()
        for b in batches:
            labels = b.column("y").to_pylist()
            for at, part in slices(b.column("t")):
                for x, y in zip(feature_sets(part, p["bits"]), labels[at:]):
                    x = x.astype(np.int32)
                    key = hashlib.blake2b(x.tobytes(), digest_size=16, salt=bytes([y & 255])).digest()
                    if key not in seen:
                        seen.add(key)
                        sets.append(x)
                        ys.append(y)
        if not sets:
            return
        m = fit_sets(sets, np.array(ys, float), p)
        yield pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in m.items()}])

    got = (
        rows.select("o", "i", "y", "t").repartition(1).sortWithinPartitions("o", "i", "y", "t").select("y", "t")
        .mapInArrow(train, "index array<bigint>, weight array<double>, bias double, threshold double, precision double, recall double")
        .collect()
    )
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 2.0, p["bits"], 0.0, 0.0)
    m = got[0]
    return Model(np.array(m["index"], np.int64), np.array(m["weight"]), m.bias, m.threshold, p["bits"], m.precision, m.recall)


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.dense = model, None

    def __getstate__(self):
        return {"model": self.model, "dense": None}

    def __call__(self, column: pa.Array) -> np.ndarray:
        m = self.model
        if self.dense is None:
            self.dense = np.zeros(1 << m.bits)
            self.dense[m.index] = m.weight
        out = np.zeros(len(column))
        for at, part in slices(column):
            idx, row, n = features(part, m.bits)
            hit = np.flatnonzero(self.dense[idx])
            key = np.unique((row[hit] << m.bits) | idx[hit])
            out[at : at + n] = np.bincount(key >> m.bits, self.dense[key & ((1 << m.bits) - 1)], n)
        return _sigmoid(out + m.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, six digits) and toxic of every row of docs."""
    scorer = _Scorer(model)

    def run(b):
        s = scorer(b.column("text"))
        yield pa.record_batch([b.column("doc_id"), pa.array(np.round(s, 6)), pa.array(s >= model.threshold)], ["doc_id", "score", "toxic"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id bigint, score double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model does not find toxic."""
    scorer, at = _Scorer(model), docs.columns.index("text")

    def run(b):
        yield b.filter(pa.array(scorer(b.column(at)) < model.threshold))

    return map_arrow(docs, run, docs.schema)
