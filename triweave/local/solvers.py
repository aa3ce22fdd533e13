"""Krylov solvers on a local problem: projected PCG and preconditioned LSMR with a certificate gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from triweave.local.actions import Action
from triweave.local.problem import Local
from triweave.model import ModelError


@dataclass
class Report:
    x: np.ndarray
    iterations: int
    stop: str
    residual: float = 0.0
    trace: list[tuple[int, float]] = field(default_factory=list)

    @property
    def converged(self) -> bool:
        return self.stop in ("converged", "zero rhs")


def pcg(p: Local, b: np.ndarray, action: Action, rel: float = 1e-8, absolute: float = 0.0, most: int = 1000, refresh: int = 25, traced: bool = False) -> Report:
    """Conjugate gradients on Gx = b in the structural range; the true residual is taken anew every ``refresh``
    iterations (every one when traced) and before it stops."""
    b = p.project(b)
    tol = max(absolute, rel * float(np.linalg.norm(b)))
    x, r = np.zeros_like(b), b.copy()
    size = float(np.linalg.norm(r))
    trace = [(0, size)]
    if size == 0:
        return Report(x, 0, "zero rhs", 0.0, trace)
    z = action(r)
    d, rho = z.copy(), float(r @ z)
    for k in range(1, most + 1):
        if rho <= 0 or not np.isfinite(rho):
            raise ModelError("breakdown", f"rho {rho}")
        gd = p.g(d)
        curvature = float(d @ gd)
        if curvature <= 0:
            raise ModelError("breakdown", f"curvature {curvature}")
        step = rho / curvature
        x, r = x + step * d, r - step * gd
        size = float(np.linalg.norm(r))
        if traced or k % refresh == 0 or size <= tol:
            r = p.project(b - p.g(x))
            size = float(np.linalg.norm(r))
        trace.append((k, size))
        if size <= tol:
            return Report(p.project(x), k, "converged", size, trace)
        z = action(r)
        rho, old = float(r @ z), rho
        d = z + rho / old * d
    return Report(p.project(x), most, "iteration limit", size, trace)


def lsmr(p: Local, y: np.ndarray, action: Action, tol: float = 1e-8, most: int = 1000, window: int = 8, gate: Callable[[np.ndarray], bool] | None = None) -> Report:
    """min |sqrt(W)(y - Bx)| by LSMR (Fong & Saunders, 2011) in the inner product of a preconditioner.

    The last ``window`` basis vectors are kept orthogonal.  A stop for convergence is vetoed while
    ``gate(x)`` refuses; the recurrence then goes on where it is.
    """
    forward = lambda x: p.root_w * p.b(x)
    back = lambda u: p.bt(p.root_w * u)
    u = p.root_w * y
    x = np.zeros(p.dim)
    beta = float(np.linalg.norm(u))
    if beta == 0:
        return Report(x, 0, "zero rhs")
    u = u / beta
    s = back(u)
    v = action(s)
    alpha = float(np.sqrt(max(v @ s, 0)))
    if alpha == 0:
        return Report(x, 0, "zero rhs")
    v, s = v / alpha, s / alpha
    kept = [(v, s)]
    zeta_bar, alpha_bar, rho, rho_bar, c_bar, s_bar = alpha * beta, alpha, 1.0, 1.0, 1.0, 0.0
    h, h_bar = v.copy(), np.zeros(p.dim)
    first, norm_a2 = alpha * beta, alpha * alpha
    for k in range(1, most + 1):
        u = forward(v) - alpha * u
        beta = float(np.linalg.norm(u))
        if beta > 0:
            u = u / beta
            s = back(u) - beta * s
            for vo, so in kept:
                s = s - (vo @ s) * so
            v = action(s)
            alpha = float(np.sqrt(max(v @ s, 0)))
            if alpha > 0:
                v, s = v / alpha, s / alpha
                kept = [*kept, (v, s)][-window:]
        else:
            alpha = 0.0
        norm_a2 += beta * beta + alpha * alpha
        rho_old, rho = rho, float(np.hypot(alpha_bar, beta))
        c, sn = alpha_bar / rho, beta / rho
        theta, alpha_bar = sn * alpha, c * alpha
        rho_bar_old, zeta_old_bar = rho_bar, zeta_bar
        theta_bar = s_bar * rho
        rho_temp = c_bar * rho
        rho_bar = float(np.hypot(rho_temp, theta))
        c_bar, s_bar = rho_temp / rho_bar, theta / rho_bar
        zeta, zeta_bar = c_bar * zeta_old_bar, -s_bar * zeta_old_bar
        h_bar = h - (theta_bar * rho / (rho_old * rho_bar_old)) * h_bar
        x = x + (zeta / (rho * rho_bar)) * h_bar
        h = v - (theta / rho) * h
        size = abs(zeta_bar)
        if alpha == 0 or beta == 0:
            return Report(p.project(x), k, "exact breakdown", size)
        if size <= tol * first and (gate is None or gate(x)):
            return Report(p.project(x), k, "converged", size)
        if size <= np.finfo(float).eps ** 2 * first:
            return Report(p.project(x), k, "stagnated", size)
    return Report(p.project(x), most, "iteration limit", abs(zeta_bar))


def gated_lsmr(p: Local, y: np.ndarray, action: Action, tol: float = 1e-8, most: int = 1000) -> tuple[Report, float]:
    """LSMR whose convergence counts only with the certificate at ``tol``; and the final certificate."""

    def gate(x: np.ndarray) -> bool:
        try:
            return p.certificate(y, p.project(x)) <= tol
        except ModelError:
            return False

    out = lsmr(p, y, action, tol, most, gate=gate)
    try:
        return out, p.certificate(y, out.x)
    except ModelError:
        return out, float("inf")
