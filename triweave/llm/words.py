"""Arrow-vectorised word splitting shared by the text operators.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]`` of the whole text; lower-casing touches A-Z only.
Nulls are empty texts.  Work is cut into slices of bounded text size, so memory does not depend on how
many rows or how long texts an Arrow batch holds (one text is never cut).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20


def tidy(run):
    """``run`` over Arrow batches, after which the worker gives memory back, as it may idle beside others."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Returns unused memory to the system."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


_STATE: dict = {}


def worker_state(name, make):
    """What a worker process keeps from task to task: one operator's state at a time, the last one's."""
    if name not in _STATE:
        _STATE.clear()
        _STATE[name] = make()
    return _STATE[name]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of a batch that hold about ``limit`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(sizes):
        return
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1
    start = 0
    for end in [*cuts.tolist(), len(sizes)]:
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list]:
    """(offsets, codes, vocabulary): the words of text i are ``vocabulary[codes[offsets[i]:offsets[i+1]]]``.

    Vocabulary entries are Python strings, distinct, in order of first appearance.
    """
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])  # from offset 0
    if lower and len(texts):
        _, ends, data = texts.buffers()  # bytes.lower() is for A-Z only; the Arrow function also changes some other bytes
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, ends, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().lower())], offset=texts.offset)
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    encoded = lists.values.dictionary_encode()
    codes = np.asarray(encoded.indices)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    vocabulary = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in vocabulary[:1] or "" in vocabulary:  # white space at an end of a text splits off an empty piece
        keep = codes != vocabulary.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return offsets, codes, vocabulary


def word_hashes(vocabulary: list, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the vocabulary's words."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass"), seed) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
