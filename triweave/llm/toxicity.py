"""Operator 2, toxicity by a classifier chain.

Categories are predicted one after another by sparse logistic models on hashed text features; each model
also gets the log-odds of the categories before it.  In training these come from out-of-fold predictions,
so that later models see earlier ones as they will be on new texts; in scoring, from the models themselves.

Categories are columns of the labels, in the order of ``CHAIN``; the shipped labels hold two bits, so the chain is
low quality, which junk and abuse share in part, and then ``toxic``.  Labels with more categories make a longer chain:
pass their expressions.  The last category of the chain is the one that documents are flagged by.

Training takes at most ``most`` labelled documents; every document is scored, whole.  Words are features
by presence, so length does not dilute a toxic word.

Defined results: null and empty texts have no features, score by the intercepts and are not flagged;
without both classes of a category, its probability is the share seen (0 without labels); repeated rows
each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm.features import BITS, Sparse, labelled_sample, sigmoid, sums, text_features
from triweave.llm.words import text_slices, worker_state

MOST, FOLDS, L1, STEPS, FLAG_AT = 20_000, 3, 5e-5, 120, 0.5
#: The categories, each with its expression over the labels' columns.
CHAIN = {"low_quality": "1 - quality", "toxic": "toxic"}


@dataclass
class ChainModel:
    """Of each category: bucket weights, weights of the log-odds before it, intercept."""

    weights: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        odds = np.zeros((len(rows), 0))
        for w, v, c in zip(self.weights, self.links, self.intercepts, strict=True):
            odds = np.column_stack((odds, np.clip(sums(w, rows) + odds @ v + c, -8, 8)))
        return sigmoid(odds)


def fit_logistic(rows: list[np.ndarray], odds: np.ndarray, y: np.ndarray, l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket weights, weights of ``odds``, intercept) by accelerated proximal gradient steps, L1 on bucket weights."""
    n, k = odds.shape
    if not n or y.min() == y.max():
        return np.zeros(1 << BITS), np.zeros(k), 8.0 if n and y[0] else -8.0
    x = Sparse(rows, y)
    scale = np.maximum(np.abs(odds).max(axis=0), 1) if k else np.ones(0)
    z = odds / scale
    m = x.shape[1]
    dense = np.concatenate((np.zeros(m, bool), np.ones(k + 1, bool)))

    def eta(p):
        return x.dot(p[:m]) + z @ p[m : m + k] + p[-1]

    def value(p):
        e = eta(p)
        return (np.logaddexp(0, e) - y * e).mean()

    p = np.zeros(m + k + 1)
    p[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    old, at, t, step = p, p, 1.0, 4.0
    for _ in range(steps):
        e = eta(at)
        r = (sigmoid(e) - y) / n
        grad = np.concatenate((x.back(r), z.T @ r, [r.sum()]))
        here = (np.logaddexp(0, e) - y * e).mean()
        while True:
            new = at - step * grad
            new = np.where(dense, new, np.sign(new) * np.maximum(np.abs(new) - step * l1, 0))
            d = new - at
            if value(new) <= here + grad @ d + d @ d / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, old, t = new + (t - 1) / t1 * (new - old), new, t1
        step *= 1.1
    return x.spread(old[:m]), old[m : m + k] / scale, float(old[-1])


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> ChainModel:
    """``labels``: a column of 0/1 for each category, in the order of the chain."""
    model, odds = ChainModel(), np.zeros((len(rows), 0))
    fold = np.arange(len(rows)) % folds
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        w, v, c = fit_logistic(rows, odds, y)
        model.weights.append(w)
        model.links.append(v)
        model.intercepts.append(c)
        if j + 1 < labels.shape[1]:
            out = np.zeros(len(rows))
            for f in range(folds):
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                fw, fv, fc = fit_logistic([rows[i] for i in rest], odds[rest], y[rest])
                out[own] = sums(fw, [rows[i] for i in own]) + odds[own] @ fv + fc
            odds = np.column_stack((odds, np.clip(out, -8, 8)))
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, most: int = MOST, chain: dict[str, str] = CHAIN) -> ChainModel:
    """Fitted on documents whose labels have every category; above 0 is in."""
    kinds = labels.select("doc_id", *(F.expr(e).cast("long").alias(f"c{j}") for j, e in enumerate(chain.values())))
    rows, y = labelled_sample(docs, kinds, [f"c{j}" for j in range(len(chain))], most)
    return fit_chain(rows, np.column_stack([y[f"c{j}"] > 0 for j in range(len(chain))]).astype(int))


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        model = ChainModel(links=shared.value[1], intercepts=shared.value[2])
        for at, w in shared.value[0]:
            full = np.zeros(1 << BITS)
            full[at] = w
            model.weights.append(full)
        for batch in batches:
            for part in text_slices(batch):
                rows = text_features(part.column("text"))
                p = model.probabilities(rows)
                flag = (p[:, -1] >= FLAG_AT) & np.array([len(r) > 0 for r in rows], bool)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.round(p[:, j], 6)) for j in range(p.shape[1])), pa.array(flag)], names=["doc_id", *names, "flagged"])

    return run


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN) -> DataFrame:
    """(doc_id, a probability of each category, flagged) of every document."""
    model = toxicity_model(docs, labels, chain=chain)
    used = [np.flatnonzero(w) for w in model.weights]
    shared = spark.sparkContext.broadcast(([(at, w[at]) for at, w in zip(used, model.weights, strict=True)], model.links, model.intercepts))
    return docs.select("doc_id", "text").mapInArrow(_score(shared, list(chain)), "doc_id long, " + ", ".join(f"{c} double" for c in chain) + ", flagged boolean")
