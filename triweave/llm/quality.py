"""Operator 6, quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > j | x) = sigmoid(w.x - threshold_j), one vector of hashed-text weights for all grades and rising
thresholds, fitted by accelerated proximal gradient steps (L1 on the weights) on at most ``most`` labelled
documents.  Scores of all documents: the expected grade, sum over j of P(grade > j), and the tail
probability P(grade >= keep_grade), by which documents are kept.

Grades come from the labels: 0 low quality, 1 good quality but toxic, 2 good quality.

Defined results: null and empty texts have no features and score by the thresholds alone, but are
rejected, as they hold nothing; labels with nulls don't count; without usable labels, or with one grade
only, every document gets that grade (the highest, if none) and is kept unless empty; repeated rows each
get a row; extra columns stay out of scores, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm.features import BITS, Sparse, labelled_sample, sigmoid, sums, text_features
from triweave.llm.words import give_back, text_slices, tidy, worker_state

MOST, GRADES, KEEP_GRADE, KEEP_TAIL, L1, STEPS = 20_000, 3, 1, 0.5, 5e-5, 120


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > j) for each row and j."""
        return sigmoid(sums(self.weights, rows)[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    """Minimises the mean negative log likelihood of P(grade > j) differences plus an L1 term.

    Thresholds are a first value and positive gaps, so they stay in order.
    """
    n = len(rows)
    seen = np.unique(grades)
    if len(seen) < 2:
        grade = int(seen[0]) if len(seen) else n_grades - 1
        return OrdinalModel(np.zeros(1 << BITS), np.array([-40.0 if j < grade else 40.0 for j in range(n_grades - 1)]))
    x = Sparse(rows, grades.astype(float))
    share = np.array([((grades > j).sum() + 0.5) / (n + 1) for j in range(n_grades - 1)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    w, first, gaps = np.zeros(x.shape[1]), start[0], np.log(np.maximum(np.diff(start), 1e-3))

    def loss(w, first, gaps, slopes=True):
        th = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
        eta = x.dot(w)
        up = np.column_stack((np.ones(n), sigmoid(eta[:, None] - th), np.zeros(n)))  # P(grade > j - 1)
        p = np.maximum(up[np.arange(n), grades] - up[np.arange(n), grades + 1], 1e-12)
        if not slopes:
            return (-np.log(p).mean(),)
        slope = up * (1 - up)
        d_eta = -(slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / p / n
        d_th = np.zeros(n_grades - 1)
        for j in range(n_grades - 1):
            d_th[j] = ((grades == j + 1) * slope[:, j + 1] / p).sum() / n - ((grades == j) * slope[:, j + 1] / p).sum() / n
        tail = np.cumsum(d_th[::-1])[::-1]
        return -np.log(p).mean(), x.back(d_eta), tail[0], tail[1:] * np.exp(gaps)

    step, (w0, f0, g0), t0 = 1.0, (w, first, gaps), 1.0
    y = (w, first, gaps)
    for _ in range(steps):
        value, dw, df, dg = loss(*y)
        while True:
            moved = y[0] - step * dw
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), y[1] - step * df, y[2] - step * dg
            gap = new[0] - y[0], new[1] - y[1], new[2] - y[2]
            bound = value + dw @ gap[0] + df * gap[1] + dg @ gap[2] + (gap[0] @ gap[0] + gap[1] ** 2 + gap[2] @ gap[2]) / (2 * step)
            if loss(*new, slopes=False)[0] <= bound + 1e-12 or step < 1e-6:
                break
            step /= 2
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        y = tuple(a + (t0 - 1) / t1 * (a - b) for a, b in zip(new, (w0, f0, g0), strict=True))
        (w0, f0, g0), t0 = new, t1
        step *= 1.1
    return OrdinalModel(x.spread(w0), np.concatenate(([f0], f0 + np.cumsum(np.exp(g0)))))


def quality_model(docs: DataFrame, labels: DataFrame, most: int = MOST) -> OrdinalModel:
    rows, y = labelled_sample(docs, labels, ["quality", "toxic"], most)
    give_back()
    model = fit_ordinal(rows, np.where(y["quality"] <= 0, 0, np.where(y["toxic"] > 0, 1, 2)))
    del rows
    give_back()
    return model


def _score(shared, columns: list[str], keep_grade: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        columns_of, weights, thresholds = shared.value
        model = OrdinalModel(np.zeros(1 << BITS), thresholds)
        model.weights[columns_of] = weights
        for batch in batches:
            for part in text_slices(batch):
                rows = text_features(part.column("text"))
                tails = model.tails(rows)
                more = [tails.sum(axis=1), tails[:, keep_grade - 1], np.array([len(r) > 0 for r in rows], bool)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *map(pa.array, more)], names=[*columns, "expected_grade", "tail_probability", "has_words"])

    return run


def score_quality(spark: SparkSession, docs: DataFrame, model: OrdinalModel, keep_grade: int = KEEP_GRADE) -> DataFrame:
    """(row, expected_grade, tail_probability, has_words), ``row`` being a struct of the columns of ``docs``, whatever their names."""
    used = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((used, model.weights[used], model.thresholds))
    plain = docs.toDF(*[f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)])
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", expected_grade double, tail_probability double, has_words boolean"
    scored = plain.mapInArrow(tidy(_score(shared, plain.columns, keep_grade)), schema)
    row = F.struct(*(F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True)))
    return scored.select(row.alias("row"), "expected_grade", "tail_probability", "has_words")


def quality_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every document."""
    scored = score_quality(spark, docs.select("doc_id", "text"), quality_model(docs, labels))
    return scored.select("row.doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), kept().alias("keep"))


def kept() -> Column:
    return F.col("has_words") & (F.col("tail_probability") >= KEEP_TAIL)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return score_quality(spark, docs, quality_model(docs, labels)).where(kept()).select("row.*")
