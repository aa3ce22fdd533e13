"""Hashed text features for the linear models: distinct words, word shapes and repetition, whole texts.

A text's features are a set of bucket numbers below 2**BITS: its distinct words (A-Z lower-cased, outer
punctuation trimmed), and, as bins of their share among all words, the shapes of its words (letters
folded to case, digits to 0, other characters kept, runs shortened) and the share of distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.llm.words import split_words, text_slices, word_hashes

BITS, SHARE_BINS = 20, 10
_TRIM = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¡¿"
_RUNS = re.compile(r"(.)\1+", re.S)
_FOLD = str.maketrans({**{chr(c): "0" for c in range(48, 58)}})


def shape(word: str) -> str:
    """THE!! -> A!, word, -> a, and 12.5 -> 0.0, say."""
    folded = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", folded)


def text_features(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct bucket numbers of each text."""
    offsets, codes, vocabulary = split_words(texts, lower=False)
    buckets = np.uint64((1 << BITS) - 1)
    trimmed = [(w.strip(_TRIM) or w).lower() for w in vocabulary]
    word_of = (word_hashes(trimmed, 1) & buckets).astype(np.int64)[codes]
    number: dict[str, int] = {}
    shape_code = np.array([number.setdefault(shape(w), len(number)) for w in vocabulary], np.int64)[codes]
    shapes = list(number)
    bins = word_hashes([f"{s}\0{b}" for s in shapes for b in range(SHARE_BINS + 1)], 2)
    shape_of = (bins & buckets).astype(np.int64).reshape(len(shapes), SHARE_BINS + 1)
    variety = (word_hashes([f"distinct\0{b}" for b in range(SHARE_BINS + 1)], 3) & buckets).astype(np.int64)
    length = (word_hashes([f"words\0{b}" for b in range(64)], 4) & buckets).astype(np.int64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a == b:
            out.append(variety[:0])
            continue
        words = np.unique(word_of[a:b])
        kinds, times = np.unique(shape_code[a:b], return_counts=True)
        share = np.ceil(SHARE_BINS * times / (b - a)).astype(np.int64)
        more = [variety[int(np.ceil(SHARE_BINS * len(words) / (b - a)))], length[(b - a).bit_length()]]
        out.append(np.unique(np.concatenate((words, shape_of[kinds, share], more))))
    return out


def _featurise(extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                x = [f.astype("<u4").tobytes() for f in text_features(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), pa.array(x, pa.binary())], names=[*extra, "x"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Features and labels of at most ``most`` labelled documents, those whose id's hash comes first.

    Rows with null labels or without a document don't count; of several rows of one doc_id, the one whose features
    come first as bytes does, whatever their order.
    """
    usable = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *columns])).select("doc_id", *columns)
    chosen = usable.groupBy("doc_id").agg(*(F.min(c).cast("long").alias(c) for c in columns)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = chosen.toPandas()
    if not len(chosen):
        return [], {c: np.zeros(0, np.int64) for c in columns}
    small = docs.sparkSession.createDataFrame(chosen)  # at most ``most`` short rows
    rows = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    kinds = ", ".join(f"{c} long" for c in columns)
    got = rows.mapInArrow(_featurise(["doc_id", *columns]), f"doc_id long, {kinds}, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable")
    got = got.drop_duplicates("doc_id")
    return [np.frombuffer(x, "<u4").view(np.int32) for x in got.x], {c: got[c].to_numpy(np.int64) for c in columns}


class Sparse:
    """A 0/1 matrix with rows of bucket numbers, of the buckets that occur in at least ``least`` rows and
    whose presence goes with ``y``: more than ``score`` standard errors from independence."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, least: int = 4, score: float = 4.0):
        n = len(rows)
        flat = np.concatenate([np.zeros(0, np.int32), *rows])  # 32 bits throughout: all labelled rows are in the driver
        seen = np.bincount(flat, minlength=1 << BITS)
        centred = y - y.mean()
        moved = np.bincount(flat, np.repeat(centred.astype(np.float32), [len(r) for r in rows]), minlength=1 << BITS)
        error = np.sqrt(np.maximum(seen * (1 - seen / max(n, 1)) * (centred**2).mean(), 1e-12))
        self.columns = np.flatnonzero((seen >= least) & (np.abs(moved) > score * error))
        place = np.full(1 << BITS, -1, np.int32)
        place[self.columns] = np.arange(len(self.columns))
        at = place[flat]
        del flat
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        keep = at >= 0
        row, at = row[keep], at[keep]
        self.shape = len(rows), len(self.columns)
        by_column = np.argsort(at, kind="stable")
        self.at, self.row = at, row[by_column]
        self.row_starts = np.searchsorted(row, np.arange(len(rows), dtype=np.int32))
        self.column_starts = np.searchsorted(at[by_column], np.arange(len(self.columns), dtype=np.int32))
        del by_column
        self.empty = np.bincount(row, minlength=len(rows)) == 0

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.append(w[self.at], 0.0), self.row_starts) if self.shape[0] else np.zeros(0)
        out[self.empty] = 0
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.add.reduceat(r[self.row], self.column_starts) if self.shape[1] else np.zeros(0)

    def spread(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.columns] = w
        return out


def sums(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """weights summed over each row's buckets."""
    return np.array([weights[r].sum() for r in rows], float)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
