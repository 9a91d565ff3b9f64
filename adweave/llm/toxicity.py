"""Toxicity score: character n-grams, log-count ratios, a linear classifier.

A text is the set of its character n-grams (orders 3 to 5, hashed).  Each
feature is scaled by its naive Bayes log-count ratio, and a logistic regression
with weight decay is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import held_out, table

ORDERS = (3, 4, 5)
BITS = 18


def features(text: str | None) -> np.ndarray:
    """The distinct n-gram features of the whole text, as int32 ids.

    The text is lower-cased and put between spaces; all other characters than
    letters and digits count as they are.  A null text is an empty one.
    """
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    seen = np.zeros(1 << BITS, dtype=bool)
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        rolling = rolling[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in ORDERS:
            mixed = (rolling + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            seen[(mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class ToxicityModel:
    """``weights``: of each feature, ratio and regression weight multiplied."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text)
        z = self.bias + float(self.weights[found].sum()) / max(1.0, float(np.sqrt(len(found))))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def _regress(rows: list[np.ndarray], y: np.ndarray, decay: float = 1e-6, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias from feature sets and 0/1 labels, in double precision.

    Steps are Adam's over mini-batches in a fixed order, so that a fit on the
    same rows gives the same model.
    """
    size = 1 << BITS
    pos, neg = np.ones(size), np.ones(size)
    for ids, label in zip(rows, y, strict=True):
        (pos if label else neg)[ids] += 1
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    w, b = np.zeros(size), 0.0
    mean, square = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7).permutation(len(rows))
    step = 0
    for _ in range(epochs):
        for k in range(0, len(order), 256):
            batch = [rows[i] for i in order[k : k + 256]]
            lengths = np.array([len(x) for x in batch])
            ids, doc = np.concatenate(batch), np.repeat(np.arange(len(batch)), lengths)
            x = ratio[ids] / np.sqrt(np.maximum(1, lengths))[doc]
            z = np.bincount(doc, weights=x * w[ids], minlength=len(batch)) + b
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[order[k : k + 256]]
            grad = np.bincount(ids, weights=x * error[doc], minlength=size) / len(batch) + decay * w
            step += 1
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            b -= 0.5 * float(error.mean())
    return (w * ratio).astype(np.float32), float(b)


def _calibrate(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset that turn raw scores into log-odds where a ``share`` is toxic."""
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y == 0).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(200):  # damped Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        grad = np.array([(weight * (p - y) * z).sum() + 1e-3 * (slope - 1), (weight * (p - y)).sum() + 1e-5 * offset])
        curve = weight * p * (1 - p)
        hess = np.array([[(curve * z * z).sum() + 1e-3, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-5]])
        move = np.linalg.solve(hess, grad)
        slope, offset = slope - 0.5 * move[0], offset - 0.5 * move[1]
    return max(float(slope), 1e-3), float(offset)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows_per_class: int = 2000) -> ToxicityModel:
    """A model from at most ``rows_per_class`` labelled texts of each class.

    Bound: those with the smallest key hashes are taken, so the choice is the
    same at every size and order of rows.  Rows with a null label, or whose key
    isn't in ``docs``, teach nothing; repeated rows count as often as they
    stand.  A fifth of the sample sets slope and offset of the score, for the share
    of toxic rows among all labels given.
    With no row of one class the model scores every text with that share.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), (F.col(label) > 0).cast("int").alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = (count.get(1, 0) + 0.5) / (sum(count.values()) + 1)
    prior = float(np.log(share / (1 - share)))
    if min(count.get(0, 0), count.get(1, 0)) == 0:
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), prior)
    ranked = known.withColumn("h", F.xxhash64(F.col("k").cast("string")))
    chosen = ranked.where("y = 1").orderBy("h", "k").limit(rows_per_class).unionByName(ranked.where("y = 0").orderBy("h", "k").limit(rows_per_class))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")  # a bounded side

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf.h, "y": pdf.y, "ids": [features(t).tobytes() for t in pdf.text]})

    rows = sorted((r["h"], r["y"], bytes(r["ids"])) for r in texts.mapInPandas(gather, "h long, y int, ids binary").collect())
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), prior)
    ids = [np.frombuffer(r[2], dtype=np.int32) for r in rows]
    check = np.arange(len(rows)) % 5 == 0
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check[:] = True
        fitted = np.arange(len(rows))
    else:
        fitted = np.flatnonzero(~check)
    weights, bias = _regress([ids[i] for i in fitted], y[fitted])
    raw = np.array([bias + float(weights[ids[i]].sum()) / max(1.0, float(np.sqrt(len(ids[i])))) for i in np.flatnonzero(check)])
    slope, offset = _calibrate(raw, y[check], share)
    return ToxicityModel((weights * slope).astype(np.float32), bias * slope + offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Whole texts are read; null and empty texts get a score as well.  Columns
    named ``score`` or ``predicted`` in ``docs`` are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 floats: 1 MB

    @F.pandas_udf("double")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", decide(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score_toxicity(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
