"""Parametric test problems: keys by formula, weights in quarters from a seeded generator."""

from __future__ import annotations

import numpy as np


def quarters(n: int, seed: int = 0) -> np.ndarray:
    """n weights from 0.5 to 3, exact in binary."""
    return np.random.default_rng(seed).integers(2, 13, n) / 4


def planted_clones(groups: int, clones: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([(f * clones + i, s * clones + j, ((f + s) % groups) * clones + k) for f in range(groups) for s in range(groups) for i in range(clones) for j in range(clones) for k in range(clones)])
    return keys, quarters(len(keys))


def latin_square(n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = (x.ravel() for x in np.mgrid[:n, :n])
    return np.column_stack((i, j, (i + j) % n)), quarters(n * n)


def weak_chain(n: int, bridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal tuples and three weak bridges between neighbours."""
    i = np.arange(n)
    keys, w = [np.column_stack((i, i, i))], [quarters(n)]
    j = i[:-1]
    for q in range(3):
        keys.append(np.column_stack([j + (p == q) for p in range(3)]))
        w.append(np.full(n - 1, bridge))
    return np.concatenate(keys), np.concatenate(w)


def nested_third(n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = (x.ravel() for x in np.mgrid[:n, :n])
    return np.column_stack((i, j, i)), quarters(n * n)


def nearly_nested(n: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    i, j = (x.ravel() for x in np.mgrid[:n, :n])
    w = quarters(n * n)
    return np.concatenate((np.column_stack((i, j, i)), np.column_stack((i, j, (i + 1) % n)))), np.concatenate((w, eps * w))


def disconnected_latin(n: int) -> tuple[np.ndarray, np.ndarray]:
    keys, _ = latin_square(n)
    both = np.concatenate((keys, keys + n))
    return both, quarters(len(both))
