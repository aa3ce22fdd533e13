"""Dense terminal: spectral pseudoinverse and range diagnostics of symmetric semidefinite matrices."""

from __future__ import annotations

import numpy as np

from triweave.model import ModelError

MOST = 256


class Pseudoinverse:
    """Keeps eigenvalues above tol * max|eigenvalue|; one below minus that is an error."""

    def __init__(self, matrix: np.ndarray, tol: float = 1e-12):
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        cut = tol * np.abs(values).max(initial=0)
        if (values < -cut).any():
            raise ModelError("negative eigenvalue", str(values.min()))
        keep = values > cut
        self.vectors, self.inverse, self.rank, self.nullity = vectors[:, keep], 1 / values[keep], int(keep.sum()), int((~keep).sum())
        self.condition = float(values[keep].max() / values[keep].min()) if keep.any() else 0.0

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return self.vectors @ (self.inverse * (self.vectors.T @ r).T).T


def spectrum(g: np.ndarray, action, tol: float = 1e-12) -> dict:
    """Of a preconditioner on the range of g: condition number, symmetry defect, leakage, negative directions."""
    values, vectors = np.linalg.eigh(g)
    keep = values > tol * values.max(initial=0)
    q, null = vectors[:, keep], vectors[:, ~keep]
    m = np.column_stack([action(e) for e in np.eye(len(g))])
    scale = np.linalg.norm(m) or 1.0
    root = q * np.sqrt(values[keep])
    inner = np.linalg.eigvalsh((root.T @ ((m + m.T) / 2) @ root))
    return {
        "rank": int(keep.sum()),
        "nullity": int((~keep).sum()),
        "condition": float(inner.max() / inner.min()) if len(inner) and inner.min() > 0 else float("inf"),
        "symmetry_defect": float(np.linalg.norm(m - m.T) / scale),
        "leakage": float(np.linalg.norm(null.T @ m) / scale) if null.size else 0.0,
        "negative_directions": int((inner <= 0).sum()),
        "stationary_radius": float(np.abs(1 - inner).max(initial=0)),
    }
