"""Aggregation maps built in a task: neighbourhood affinity, bootstrap vectors, matching, gates and probes."""

from __future__ import annotations

import numpy as np

from triweave.local.actions import Action, Hierarchy, coarse_correction, jacobi, symmetric_map, two_grid
from triweave.local.dense import MOST
from triweave.local.problem import Local, coarse_index

DIMENSION_RATIO, TUPLE_REDUCTION, COMPLEXITY = 0.75, 0.02, 1.98


def neighborhood_pairs(p: Local, keep: int = 16, least: float = 0.02) -> list[tuple[int, int, int, float]]:
    """(q, l, r, affinity) of levels that share a neighbour in a pair marginal, in one component."""
    out = []
    for q in range(3):
        keys, overlaps = [np.zeros(0, np.int64)], [np.zeros(0)]
        for o in (x for x in range(3) if x != q):
            cell, inverse = np.unique(p.keys[:, o] * p.sizes[q] + p.keys[:, q], return_inverse=True)
            row, level, w = cell // p.sizes[q], cell % p.sizes[q], np.bincount(inverse, p.w)
            order = np.lexsort((level, -w, row))
            row, level, w = row[order], level[order], w[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, level, w = row[place < keep], level[place < keep], w[place < keep]
            for k in range(1, keep):
                at = np.flatnonzero(row[k:] == row[:-k])
                left, right = np.minimum(level[at], level[at + k]), np.maximum(level[at], level[at + k])
                keys.append(left * p.sizes[q] + right)
                overlaps.append(np.minimum(w[at], w[at + k]))
        pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        left, right = pair // p.sizes[q], pair % p.sizes[q]
        d = 2 * p.diag[p.offsets[q] : p.offsets[q + 1]]
        affinity = np.minimum(np.bincount(inverse, np.concatenate(overlaps), len(pair)) / np.sqrt(d[left] * d[right]), 1.0)
        good = affinity >= least
        out += [(q, int(i), int(j), float(v)) for i, j, v in zip(left[good], right[good], affinity[good], strict=True)]
    return out


def match(p: Local, pairs: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Parents within each factor, from greedy matching in order of affinity, left, right."""
    parent = []
    for q in range(3):
        head = np.arange(p.sizes[q])
        free = np.ones(p.sizes[q], bool)
        for _, left, right, _ in sorted((x for x in pairs if x[0] == q), key=lambda x: (-x[3], x[1], x[2])):
            if free[left] and free[right]:
                free[left] = free[right] = False
                head[right] = left
        parent.append(np.unique(head, return_inverse=True)[1])
    return np.concatenate(parent)


def consecutive(p: Local) -> np.ndarray:
    return np.concatenate([np.arange(n) // 2 for n in p.sizes])


def structural_gate(p: Local, parent: np.ndarray) -> tuple[bool, dict[str, float]]:
    coarse = p.coarsen(parent)
    m = {"dimension_ratio": coarse.dim / p.dim, "tuple_reduction": 1 - len(coarse.w) / len(p.w), "complexity": 1 + len(coarse.w) / len(p.w)}
    return m["dimension_ratio"] <= DIMENSION_RATIO and m["tuple_reduction"] >= TUPLE_REDUCTION and m["complexity"] <= COMPLEXITY, m


def test_vectors(p: Local, count: int = 8, sweeps: int = 8, seed: int = 1) -> list[np.ndarray]:
    """Smooth vectors in the range of G: random, times G, then Jacobi sweeps on Gx = 0, D-normalised, first entry up."""
    rng, smooth, out = np.random.default_rng(seed), jacobi(p), []
    for _ in range(count):
        x = p.project(p.g(rng.uniform(-1, 1, p.dim)))
        for _ in range(sweeps):
            x = p.project(x - smooth(p.g(x)))
        size = np.sqrt(x @ (p.diag * x)) or 1.0
        first = np.flatnonzero(x)
        out.append(x / size * (np.sign(x[first[0]]) if len(first) else 1.0))
    return out


def bootstrap_pairs(p: Local, vectors: list[np.ndarray], least: float = 0.35, window: int = 3) -> list[tuple[int, int, int, float]]:
    """Candidates by structure or by nearness in a vector's order, scored .55 algebraic, .25 structural, .10 degree, .10 signature."""
    structural = {(q, a, b): v for q, a, b, v in neighborhood_pairs(p)}
    comp, pool = p.components, set(structural)
    near: dict[tuple[int, int, int], float] = {}
    for q in range(3):
        own = slice(p.offsets[q], p.offsets[q + 1])
        for x in vectors:
            order = np.lexsort((np.arange(p.sizes[q]), x[own], comp[own]))
            for k in range(1, window + 1):
                for i, j in zip(order[:-k], order[k:], strict=True):
                    if comp[own][i] == comp[own][j]:
                        key = (q, int(min(i, j)), int(max(i, j)))
                        pool.add(key)
                        near[key] = max(near.get(key, 0.0), 1 - (k - 1) / window)
    out = []
    for q, i, j in sorted(pool):
        a = np.array([x[p.offsets[q] + i] for x in vectors])
        b = np.array([x[p.offsets[q] + j] for x in vectors])
        algebraic = float((a @ b) ** 2 / ((a @ a) * (b @ b))) if (a @ a) * (b @ b) > 0 else 0.0
        d = p.diag[p.offsets[q] + i], p.diag[p.offsets[q] + j]
        score = 0.55 * algebraic + 0.25 * structural.get((q, i, j), 0.0) + 0.10 * min(d) / max(d) + 0.10 * near.get((q, i, j), 0.0)
        if score >= least:
            out.append((q, i, j, score))
    return out


def compatible_relaxation(p: Local, parent: np.ndarray, vectors: int = 8, sweeps: int = 8, seed: int = 2, smoother: Action | None = None) -> dict:
    """How fast the smoother contracts what the coarse space can't hold, in the D-norm; and the slowest vector."""
    at, smooth, rng = coarse_index(parent, p.sizes), smoother or jacobi(p), np.random.default_rng(seed)
    mass = np.bincount(at, p.diag)

    def off(x: np.ndarray) -> np.ndarray:
        return x - (np.bincount(at, p.diag * x) / mass)[at]

    worst, witness = 0.0, np.zeros(p.dim)
    for _ in range(vectors):
        x = off(rng.uniform(-1, 1, p.dim))
        start = np.sqrt(x @ (p.diag * x))
        if start < 1e-12 * np.sqrt(p.diag.sum()):
            continue
        for _ in range(sweeps):
            x = off(x - smooth(p.g(x)))
        factor = (np.sqrt(x @ (p.diag * x)) / start) ** (1 / sweeps)
        if factor > worst:
            worst, witness = float(factor), x
    return {"factor": worst, "witness": witness, "coarse_defect": float(np.abs(np.bincount(at, p.diag * witness)).max(initial=0))}


def cycle_probe(p: Local, action: Action, starts: int = 8, steps: int = 16, tail: int = 4, seed: int = 3) -> float:
    """Estimated energy-norm factor of I - MG by power iteration: the largest tail geometric mean."""
    rng, worst = np.random.default_rng(seed), 0.0
    for _ in range(starts):
        x = p.project(rng.uniform(-1, 1, p.dim))
        factors = []
        size = np.sqrt(p.energy(x))
        for _ in range(steps):
            if size <= 1e-12 * np.sqrt(x @ (p.diag * x)):  # only a kernel vector is left, whose energy is rounding
                break
            x = x / size
            x = p.project(x - action(p.g(x)))
            size = np.sqrt(p.energy(x))
            factors.append(size)
        if factors:
            worst = max(worst, float(np.exp(np.mean(np.log(np.maximum(factors[-tail:], 1e-300))))))
    return worst


def split_repair(p: Local, parent: np.ndarray, witness: np.ndarray) -> np.ndarray:
    """Splits the aggregate with most D-energy about its mean at the largest gap of the witness."""
    at = coarse_index(parent, p.sizes)
    mean = np.bincount(at, p.diag * witness) / np.bincount(at, p.diag)
    spread = np.bincount(at, p.diag * (witness - mean[at]) ** 2)
    worst = int(np.argmax(spread))
    own = np.flatnonzero(at == worst)
    if len(own) < 2 or spread[worst] <= 0:
        return parent
    order = own[np.lexsort((own, witness[own]))]
    cut = int(np.argmax(np.diff(witness[order]))) + 1
    q = int(np.searchsorted(p.offsets, own[0], side="right")) - 1
    label = parent.copy()
    label[order[cut:]] = parent[p.offsets[q] : p.offsets[q + 1]].max() + 1
    sl = slice(p.offsets[q], p.offsets[q + 1])
    heads = {}
    for i, v in enumerate(label[sl]):
        heads.setdefault(int(v), i)
    order_of = {v: k for k, v in enumerate(sorted(heads, key=heads.get))}
    label[sl] = [order_of[int(v)] for v in label[sl]]
    return label


def portfolio(p: Local, rounds: int = 2, factor_most: float = 0.9) -> tuple[np.ndarray | None, dict]:
    """The better, by its complete two-grid cycle, of the learned and the neighbourhood map that pass the structural gates."""
    vectors, learned = test_vectors(p), None
    for _ in range(rounds):
        learned = match(p, bootstrap_pairs(p, vectors))
        relax = compatible_relaxation(p, learned)
        if relax["factor"] <= 0.7:
            break
        size = np.sqrt(relax["witness"] @ (p.diag * relax["witness"])) or 1.0
        vectors = [*vectors, relax["witness"] / size]
    best, report = None, {}
    for name, parent in (("learned", learned), ("neighborhood", match(p, neighborhood_pairs(p)))):
        ok, metrics = structural_gate(p, parent)
        if not ok or p.coarsen(parent).dim > 2 * MOST:
            report[name] = metrics | {"accepted": False}
            continue
        factor = cycle_probe(p, two_grid(p, jacobi(p), coarse_correction(p, parent)))
        report[name] = metrics | {"factor": factor, "accepted": factor <= factor_most}
        order = (factor, metrics["complexity"], metrics["dimension_ratio"], name)
        if factor <= factor_most and (best is None or order < best[0]):
            best = order, parent
    return (best[1] if best else None), report


def paired_rest(p: Local, parent: np.ndarray) -> np.ndarray:
    """``parent`` with the levels that stand alone paired too, where two share the neighbour that holds most of their weight.

    ``neighborhood_pairs`` sees the heaviest levels of a neighbour only, so of a neighbour of very many levels most stay alone.
    A factor with under an eighth of the levels keeps all of its own: merging it would gain little and cost the cycle its speed.
    """
    out = []
    for q in range(3):
        if 8 * p.sizes[q] <= p.dim:
            out.append(np.arange(p.sizes[q]))
            continue
        own = parent[p.offsets[q] : p.offsets[q + 1]]
        alone = np.bincount(own)[own] == 1
        best, weight = np.full(p.sizes[q], -1), np.zeros(p.sizes[q])
        for o in (x for x in range(3) if x != q):
            cell, inverse = np.unique(p.keys[:, q] * p.sizes[o] + p.keys[:, o], return_inverse=True)
            level, row, w = cell // p.sizes[o], cell % p.sizes[o], np.bincount(inverse, p.w)
            order = np.lexsort((row, -w, level))
            first = order[np.flatnonzero(np.diff(level[order], prepend=-1))]
            better = w[first] > weight[level[first]]
            best[level[first][better]], weight[level[first][better]] = row[first][better] + p.offsets[o], w[first][better]
        rest = np.flatnonzero(alone)
        rest = rest[np.lexsort((rest, best[rest]))]
        place = np.arange(len(rest)) - np.searchsorted(best[rest], best[rest])
        second = np.flatnonzero(place % 2 == 1)
        head = np.unique(own, return_index=True)[1][own]
        head[rest[second]] = rest[second - 1]
        out.append(np.unique(head, return_inverse=True)[1])
    return np.concatenate(out)


def hierarchy_maps(p: Local, terminal: int = MOST, most: int = 64) -> list[np.ndarray] | None:
    """Neighbourhood maps, with the levels that these leave alone paired where too many are left, down to a terminal size, or
    None if coarsening stagnates."""
    maps, level, rest = [], p, False
    while level.dim > terminal:
        if len(maps) >= most:
            return None
        parent = match(level, neighborhood_pairs(level))
        coarse = level.coarsen(parent)
        rest = rest or coarse.dim > DIMENSION_RATIO * level.dim
        if rest:  # and so on every further level, whose small factors the cycle needs whole
            parent = paired_rest(level, parent)
            coarse = level.coarsen(parent)
        if coarse.dim > DIMENSION_RATIO * level.dim or len(coarse.w) > (1 - TUPLE_REDUCTION) * len(level.w):
            return None
        maps.append(parent)
        level = coarse
    return maps


def screened_hierarchy(p: Local, factor_most: float = 0.95, starts: int = 4, steps: int = 8) -> Hierarchy | None:
    """A V-cycle whose every tail, from the terminal upwards, contracts; else None."""
    maps = hierarchy_maps(p)
    if not maps:
        return None
    h = Hierarchy(p, maps, symmetric_map)
    for k in range(len(maps), -1, -1):
        if cycle_probe(h.levels[k], h.tail(k), starts, steps) > factor_most:
            return None
    return h
