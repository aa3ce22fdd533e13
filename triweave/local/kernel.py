"""Exact kernel of B for each component: modular elimination, rational reconstruction and an integer check."""

from __future__ import annotations

from math import gcd, lcm

import numpy as np

from triweave.local.problem import Local
from triweave.model import ModelError

PRIME, BOUND = (1 << 61) - 1, (1 << 30) - 1


def _eliminate(rows: list[tuple[int, ...]], n: int) -> dict[int, dict[int, int]]:
    """Reduced echelon rows of 0/1 rows mod PRIME, by pivot column; it stops at n - 2 pivots, the structural rank."""
    basis: dict[int, dict[int, int]] = {}
    for cols in rows:
        row: dict[int, int] = {c: 1 for c in cols}
        while row:
            lead = min(row)
            if lead not in basis:
                inverse = pow(row[lead], -1, PRIME)
                basis[lead] = {c: v * inverse % PRIME for c, v in row.items()}
                break
            factor = row[lead]
            for c, v in basis[lead].items():
                value = (row.get(c, 0) - factor * v) % PRIME
                if value:
                    row[c] = value
                else:
                    row.pop(c, None)
        if len(basis) == n - 2:
            break
    for lead in sorted(basis, reverse=True):
        row = basis[lead]
        for c in sorted(x for x in row if x != lead and x in basis):
            factor = row.get(c, 0)
            if factor:
                for k, v in basis[c].items():
                    value = (row.get(k, 0) - factor * v) % PRIME
                    if value:
                        row[k] = value
                    else:
                        row.pop(k, None)
    return basis


def _rational(value: int) -> tuple[int, int]:
    a, b, x, y = PRIME, value % PRIME, 0, 1
    while b > BOUND:
        q = a // b
        a, b, x, y = b, a - q * b, y, x - q * y
    if y < 0:
        b, y = -b, -y
    if not 0 < y <= BOUND or gcd(abs(b), y) != 1:
        raise ModelError("kernel not reconstructed")
    return b, y


def kernel_certificate(p: Local) -> list[dict]:
    """For each component: rank, nullity, whether only structural, and integer kernel vectors checked on every tuple."""
    comp, out = p.components, []
    of = comp[p.index[:, 0]]
    for k in range(int(comp.max()) + 1):
        coords = np.flatnonzero(comp == k)
        n = len(coords)
        local = {int(c): i for i, c in enumerate(coords)}
        rows = [tuple(local[int(c)] for c in r) for r in p.index[of == k]]
        basis = _eliminate(rows, n)
        vectors = []
        for f in (c for c in range(n) if c not in basis):
            parts = {lead: _rational(-row[f] % PRIME) for lead, row in basis.items() if row.get(f)}
            scale = lcm(1, *(d for _, d in parts.values()))
            v = [0] * n
            v[f] = scale
            for lead, (a, b) in parts.items():
                v[lead] = a * (scale // b)
            if any(v[i] + v[j] + v[m] for i, j, m in rows):
                raise ModelError("kernel vector fails on a tuple")
            vectors.append(v)
        out.append({"component": k, "rank": len(basis), "nullity": n - len(basis), "structural": n - len(basis) == 2, "coordinates": coords, "basis": vectors})
    return out


def range_projector(p: Local, certificates: list[dict] | None = None):
    """x -> x without its part in the certified kernel (twice orthogonalised)."""
    parts = []
    for c in certificates or kernel_certificate(p):
        q = np.array(c["basis"], float).T
        for _ in range(2):
            q, _ = np.linalg.qr(q)
        parts.append((c["coordinates"], q))

    def project(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for coords, q in parts:
            x[coords] -= q @ (q.T @ x[coords])
        return x

    return project
