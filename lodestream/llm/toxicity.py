"""Toxicity classifier: character n-grams scaled by naive Bayes log-count ratios, then logistic regression.

Fit: at most `max_rows` labelled rows, chosen by hash of doc_id, give n-gram presence by class; n-grams whose
presence differs between the classes by at least `min_z` standard deviations stay, their presence is scaled
by the log-count ratio, and a logistic regression weighs them. Score: every n-gram of the whole text.

Defined results: null and empty texts score as texts without n-grams; repeated rows score alike; a null
doc_id is never used to fit and counts as not held out; without labels of both classes the score is the
share of label 1, or 0 without labels. A text of any length is scored whole, in overlapping segments; other columns of
the documents are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_features as tf
from .common import fold, release_memory


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label): labels outside the held-out fold, at most max_rows of them by hash of doc_id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("_label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))


@dataclass
class NaiveBayesLinear:
    orders: tuple[int, ...] = (4, 5)
    bits: int = 20
    min_z: float = 5.0
    bias: float = -30.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, bucket) pairs; after the fit only of buckets with a weight."""
        found = []
        for owner, bucket in tf.char_ngrams(texts, self.orders, self.bits):
            key = owner << self.bits | bucket
            found.append(np.unique(key[self.weights[bucket] != 0] if len(self.weights) else key))
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return key >> self.bits, key & (1 << self.bits) - 1

    def fit(self, rows: list[np.ndarray], y: np.ndarray, step: int = 200) -> NaiveBayesLinear:
        """rows: each text's distinct buckets. They are counted and then reduced to the chosen ones step texts at a time."""
        size, pos = 1 << self.bits, float(y.sum())
        self.weights = np.zeros(size, np.float32)
        n, share = len(y), pos / len(y) if len(y) else 0.0
        self.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        if not 0 < pos < n:
            return self
        in_pos, seen = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for k in range(0, n, step):
            part, mark = rows[k : k + step], y[k : k + step]
            seen += np.bincount(np.concatenate(part), minlength=size).astype(np.int32)
            if mark.any():
                in_pos += np.bincount(np.concatenate([r for r, m in zip(part, mark, strict=True) if m]), minlength=size).astype(np.int32)
        z = np.abs(in_pos - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
        keep = np.flatnonzero((z >= self.min_z) & (seen >= 3))
        if not len(keep):
            return self
        p, q = (1 + in_pos[keep]) / (2 + pos), (1 + seen[keep] - in_pos[keep]) / (2 + n - pos)
        ratio = np.log(p / q)
        place = np.full(size, -1, np.int32)
        place[keep] = np.arange(len(keep))
        chosen = [c[c >= 0] for c in (place[r] for r in rows)]
        owner, column = np.repeat(np.arange(n), [len(c) for c in chosen]), np.concatenate(chosen)
        x = ratio[column]
        w, b, g2, gb2 = np.zeros(len(keep)), self.bias, np.full(len(keep), 1e-6), 1e-6
        for _ in range(400):  # full-batch AdaGrad
            err = tf.sigmoid(np.bincount(owner, w[column] * x, n) + b) - y
            g, gb = np.bincount(column, err[owner] * x, len(keep)) / n + 1e-4 * w, err.mean()
            g2, gb2 = g2 + g * g, gb2 + gb * gb
            w, b = w - 0.2 * g / np.sqrt(g2), b - 0.2 * gb / np.sqrt(gb2)
        self.weights[keep], self.bias = (w * ratio).astype(np.float32), float(b)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        owner, bucket = self.present(texts)
        return tf.sigmoid(np.bincount(owner, self.weights[bucket], len(texts)) + self.bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, max_rows: int = 6000, **options) -> NaiveBayesLinear:
    model = NaiveBayesLinear(**options)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, run in tf.runs_of(f["text"].tolist()):
                owner, bucket = model.present(run)
                cut = np.searchsorted(owner, np.arange(1, len(run)))
                part = f.iloc[at : at + len(run)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["_label"].to_numpy(), "ids": [x.astype("<u4").tobytes() for x in np.split(bucket, cut)]})
        release_memory()

    rows = labelled_sample(docs, labels, label, folds, held_out, max_rows).mapInPandas(features, "doc_id long, y int, ids binary").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(float)
    buckets = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("ids")]  # views: one copy of the sample in memory
    model.fit(buckets, y)
    del rows, buckets
    release_memory()
    return model


def _scores(texts: pa.Array, model) -> np.ndarray:
    """Texts leave Arrow a run at a time, so that a task holds few of them as Python strings."""
    out = np.zeros(len(texts))
    for at, run in tf.runs_of(x.as_py() for x in texts):
        out[at : at + len(run)] = model.score(run)
    return out


def score(docs: DataFrame, model, folds: int, held_out: int, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted. model: anything with score(texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), shared.value))], ["doc_id", "score"])
        release_memory()

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def select_rows(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of docs, all columns, whose score(text) satisfies keep, a function of an array of scores."""
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(_scores(b.column(at_text), shared.value))))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
