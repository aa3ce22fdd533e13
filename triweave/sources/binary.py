"""Binary problem files: little-endian header, keys, weights and targets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from triweave.model import ModelError

#: Fixed values of the two file formats: magic and whether a u32 hierarchy depth follows the header.
MAGICS = {b"MG3AUT1\0": False, b"MG3BEN1\0": True}
SCHEMA = "path string, tid long, a int, b int, c int, w double, ys array<double>"


def decode(content: bytes) -> tuple[tuple[int, int, int], np.ndarray, np.ndarray, np.ndarray, int]:
    """(counts, keys E x 3, weights, targets K x E, depth)."""
    magic = content[:8]
    if magic not in MAGICS:
        raise ModelError("unknown format", repr(magic))
    n0, n1, n2, e, k = struct.unpack_from("<3IQI", content, 8)
    at = 8 + 24
    depth = 0
    if MAGICS[magic]:
        (depth,) = struct.unpack_from("<I", content, at)
        at += 4
    if len(content) != at + e * (12 + 8 + 8 * k):
        raise ModelError("length mismatch")
    keys = np.frombuffer(content, "<u4", 3 * e, at).reshape(e, 3)
    weights = np.frombuffer(content, "<f8", e, at + 12 * e)
    targets = np.frombuffer(content, "<f8", k * e, at + 20 * e).reshape(k, e)
    return (n0, n1, n2), keys, weights, targets, depth


def encode(counts: tuple[int, int, int], keys: np.ndarray, weights: np.ndarray, targets: np.ndarray, depth: int | None = None) -> bytes:
    magic = next(m for m, deep in MAGICS.items() if deep == (depth is not None))
    head = magic + struct.pack("<3IQI", *counts, len(keys), len(targets)) + (struct.pack("<I", depth) if depth is not None else b"")
    return head + np.ascontiguousarray(keys, "<u4").tobytes() + np.ascontiguousarray(weights, "<f8").tobytes() + np.ascontiguousarray(targets, "<f8").tobytes()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            _, keys, w, y, _ = decode(content.as_buffer().to_pybytes())
            for at in range(0, len(keys), 65_536):
                part = slice(at, at + 65_536)
                n = len(keys[part])
                ys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(y), pa.int32()), pa.array(np.ascontiguousarray(y[:, part].T).ravel()))
                columns = [pa.array([path] * n), pa.array(np.arange(at, at + n)), *(pa.array(keys[part][:, q].astype(np.int32)) for q in range(3)), pa.array(w[part]), ys]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "tid", "a", "b", "c", "w", "ys"])


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, tid, a, b, c, w, ys) of every file that the path names."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows, SCHEMA)
