"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Fit: FTRL-proximal passes over at most `max_rows` labelled rows, chosen by hash of doc_id, in that order.
Features are tokens and pairs of neighbours, each as a share of the text's tokens; a score is the sparse
dot product with the weights.

Defined results: null and empty texts have no n-grams and score the bias alone; repeated rows score alike; a
null doc_id is never used to fit and counts as not held out; without labels of both classes the score is the
share of label 1, or 0 without labels. A text of any length is scored whole, in segments cut behind a blank;
other columns of the documents are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import text_features as tf
from .common import release_memory
from .toxicity import labelled_sample


@dataclass
class FollowTheLeader:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4
    scale: float = 10.0
    bias: float = -30.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, bucket, value), each pair once."""
        found = [np.unique(owner << self.bits | bucket, return_counts=True) for owner, bucket in tf.word_ngrams(texts, self.bits)]
        key, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n for _, n in found]), len(key))
        owner = key >> self.bits
        total = np.bincount(owner, n, len(texts))
        return owner, key & (1 << self.bits) - 1, self.scale * n / total[owner]

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> FollowTheLeader:
        """rows: each text's (buckets, values)."""
        size, share = 1 << self.bits, float(y.mean()) if len(y) else 0.0
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        start = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        if 0 < share < 1:
            for _ in range(self.epochs):
                for (bucket, value), label in zip(rows, y, strict=True):
                    i, x = np.append(bucket.astype(np.int64), size), np.append(value.astype(float), 1.0)
                    w = self._weights(z[i], n[i])
                    g = (tf.sigmoid(np.dot(w, x) + start) - label) * x
                    grown = n[i] + g * g
                    z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / self.alpha * w
                    n[i] = grown
        w = self._weights(z, n)
        self.weights, self.bias = w[:size].astype(np.float32), start + float(w[size])
        return self

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def score(self, texts: list[str]) -> np.ndarray:
        """The values are shares of counts, so the dot product is a mean over all n-grams; none needs sorting."""
        total, dot = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, bucket in tf.word_ngrams(texts, self.bits):
            total += np.bincount(owner, minlength=len(texts))
            dot += np.bincount(owner, self.weights[bucket], len(texts))
        return tf.sigmoid(self.scale * dot / np.maximum(total, 1) + self.bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, max_rows: int = 6000, **options) -> FollowTheLeader:
    model = FollowTheLeader(**options)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, run in tf.runs_of(f["text"].tolist()):
                owner, bucket, value = model.features(run)
                cut = np.searchsorted(owner, np.arange(1, len(run)))
                part = f.iloc[at : at + len(run)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["_label"].to_numpy(), "ids": [x.astype("<u4").tobytes() for x in np.split(bucket, cut)], "values": [x.astype("<f4").tobytes() for x in np.split(value, cut)]})
        release_memory()

    rows = labelled_sample(docs, labels, label, folds, held_out, max_rows).mapInPandas(features, "doc_id long, y int, ids binary, values binary").toArrow()
    order = np.argsort(tf.mix(rows.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
    # views: one copy of the sample in memory, widened text by text
    parts = [(np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(v.as_buffer(), "<f4")) for i, v in zip(rows.column("ids"), rows.column("values"), strict=True)]
    model.fit([parts[k] for k in order], rows.column("y").to_numpy().astype(float)[order])
    del rows, parts
    release_memory()
    return model
