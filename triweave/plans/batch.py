"""Least squares of up to 32 columns whose vectors are tables: conjugate gradients, and LSMR with a certificate gate.

One run serves all columns: every product, sum and norm is taken for all of them in the same job, and only the steps, a few
numbers a column, are the driver's.  A column that is done keeps still while others go on.  Tables are written to the
shared folder, so a lost executor costs no earlier iteration.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators.columns import Columns, at, each, level_counts, sums
from triweave.operators.encode import CODES
from triweave.operators.linear import degrees
from triweave.plans.scratch import Scratch

MOST_COLUMNS, REFRESH = 32, 25


@dataclass
class Run:
    """Coefficients (q, l, x array), and of each column the iterations and why it stopped."""

    coefficients: DataFrame
    iterations: list[int]
    stops: list[str]
    vetoes: list[int]

    @property
    def converged(self) -> list[bool]:
        return [s in ("converged", "zero rhs", "exact breakdown") for s in self.stops]


def _dots(rows: DataFrame, k: int, pairs: dict[str, tuple[str, str]]) -> dict[str, np.ndarray]:
    """Sums of products of two array columns, all in one job."""
    made = rows.agg(*(F.sum(at(x, i) * at(y, i)).alias(f"{name}{i}") for name, (x, y) in pairs.items() for i in range(k))).first()
    return {name: np.array([made[f"{name}{i}"] or 0.0 for i in range(k)]) for name in pairs}


def _plus(k: int, x: str, factor: np.ndarray, y: str) -> Column:
    """x + factor * y."""
    return each(k, lambda i: at(x, i) + F.lit(float(factor[i])) * at(y, i))


Action = Callable[[DataFrame], DataFrame]


def _action(op: Columns, labels: DataFrame, d: DataFrame, kind: str | Action) -> Action:
    """The preconditioner of (q, l, x): by the diagonal, projected symmetric sweeps over the factors, or a given symmetric one, projected."""
    if callable(kind):
        return lambda r: op.project(kind(op.project(r, labels)), labels)
    if kind == "diagonal":
        return lambda r: r.join(d, ["q", "l"]).select("q", "l", each(op.k, lambda i: at("x", i) / F.col("d")).alias("x"))
    if kind == "map":
        return lambda r: op.project(op.symmetric_map(op.project(r, labels), d), labels)
    raise ModelError("unknown preconditioner", kind)


def _check(k: int) -> None:
    if not 1 <= k <= MOST_COLUMNS:
        raise ModelError("number of targets", str(k))


def pcg(tuples: DataFrame, labels: DataFrame, targets: list[str], scratch: Scratch, kind: str | Action = "diagonal", rel: float = 1e-8, most: int = 1000, grouped: bool = True, shared: Columns | None = None) -> Run:
    """Conjugate gradients on B'WBx = B'Wy in the structural range.  The true residual is taken anew every REFRESH
    iterations and before a column stops; one that then misses goes on from there.  ``shared``: the tuples' Columns, which the
    caller closes."""
    k = len(targets)
    _check(k)
    sides = tuples.select(F.posexplode(F.array(*CODES)).alias("q", "l"), "w", each(k, lambda i: F.col("w") * F.col(targets[i])).alias("_v"))
    sides = scratch.table(sides.groupBy("q", "l").agg(F.sum("w").alias("d"), sums(k, lambda i: at("_v", i)).alias("x")))
    with Columns(tuples, k, scratch, grouped, level_counts(sides), labels) if shared is None else nullcontext(shared) as op:
        d = sides.select("q", "l", "d")
        b = scratch.table(op.project(sides.select("q", "l", "x"), labels).withColumnRenamed("x", "b").join(d, ["q", "l"]))
        by_diagonal = kind == "diagonal"  # its product is a column, which needs no table of its own
        act = None if by_diagonal else _action(op, labels, d, kind)

        def preconditioned(rows: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
            if by_diagonal:
                full = rows.withColumn("z", each(k, lambda i: at("r", i) / F.col("d")))
            else:
                z = act(rows.select("q", "l", F.col("r").alias("x"))).withColumnRenamed("x", "z")
                full = scratch.table(rows.join(z, ["q", "l"]))
            return full, _dots(full, k, {"rho": ("r", "z"), "size": ("r", "r")})

        vectors = op.blocks.table if op.blocks is not None else scratch.table
        zero = each(k, lambda i: F.lit(0.0))
        held = vectors(b.repartition("q", "l").select("q", "l", "d", zero.alias("x"), F.col("b").alias("r"), zero.alias("p")))  # what the state reads
        state, dots = preconditioned(held)
        start, rho = np.sqrt(dots["size"]), dots["rho"]
        stops, iterations, beta = ["zero rhs" if s == 0 else "" for s in start], [0] * k, np.zeros(k)
        for step in range(1, most + 1):
            open_ = np.array([not s for s in stops])
            if not open_.any():
                break
            moving = state.select("q", "l", "d", "x", "r", _plus(k, "z", np.where(open_, beta, 0.0), "p").alias("p"))
            gp = op.gramian(moving.select("q", "l", F.col("p").alias("x"))).withColumnRenamed("x", "gp")
            joined = vectors(moving.join(gp, ["q", "l"]))
            for old in {id(t): t for t in (held, state)}.values():
                scratch.drop(old)
            held = joined
            curvature = _dots(joined, k, {"c": ("p", "gp")})["c"]
            for i in np.flatnonzero(open_ & ~(np.isfinite(curvature) & (curvature > 0))):  # the others go on; a certificate judges this one
                stops[i], open_[i], iterations[i] = "breakdown", False, step
            alpha = np.where(open_, rho / np.where(open_, curvature, 1.0), 0.0)
            moved = joined.select("q", "l", "d", _plus(k, "x", alpha, "p").alias("x"), _plus(k, "r", -alpha, "gp").alias("r"), "p")
            state, dots = preconditioned(moved)
            ready = open_ & (np.sqrt(dots["size"]) <= rel * start)
            anew = ready.any() or step % REFRESH == 0
            if anew:
                true = op.gramian(state.select("q", "l", "x")).withColumnRenamed("x", "gx").join(b.drop("d"), ["q", "l"])
                true = op.project(true.select("q", "l", each(k, lambda i: at("b", i) - at("gx", i)).alias("x")), labels).withColumnRenamed("x", "r")
                fresh = vectors(state.drop("r", "z").join(true, ["q", "l"]))
                for old in {id(t): t for t in (held, state)}.values():
                    scratch.drop(old)
                held = fresh
                state, dots = preconditioned(fresh)
            size = np.sqrt(dots["size"])
            for i in np.flatnonzero(open_):
                iterations[i] = step
                if anew and size[i] <= rel * start[i]:
                    stops[i] = "converged"
            beta = np.where(rho > 0, dots["rho"] / np.where(rho > 0, rho, 1.0), 0.0)
            rho = dots["rho"]
        stops = [s or "iteration limit" for s in stops]
        return Run(scratch.table(op.project(state.select("q", "l", "x"), labels)), iterations, stops, [0] * k)


def certificates(tuples: DataFrame, x: DataFrame, targets: list[str], scratch: Scratch) -> np.ndarray:
    """|B'W(y - Bx)| / |B'Wy| of each column of ``x`` (q, l, x), in one job; 0/0 is 0, and infinite where a tuple lacks a coefficient."""
    row = certificate_sums(tuples, x, targets, scratch).first()
    out = []
    for i in range(len(targets)):
        r, b = row[f"r{i}"], row[f"b{i}"]
        out.append(np.inf if np.isnan(r) or (r and not b) else 0.0 if not r else float(np.sqrt(r / b)))
    return np.array(out)


def certificate_sums(tuples: DataFrame, x: DataFrame, targets: list[str], scratch: Scratch | None) -> DataFrame:
    """One row: squared norms r0, b0, r1, ... of the columns' residuals and right-hand sides; NaN where a tuple lacks a coefficient."""
    k = len(targets)
    op = Columns(tuples, k, scratch, counts=(1 << 40,) * 3)  # sizes are Spark's to judge
    fitted = op.image(x, how="left")
    residual = lambda i: F.coalesce(F.col("w") * (F.col(targets[i]) - at("bx", i)), F.lit(float("nan")))
    rows = fitted.select(F.posexplode(F.array("a", "b", "c")).alias("q", "l"), each(k, residual).alias("r"), each(k, lambda i: F.col("w") * F.col(targets[i])).alias("b"))
    parts = rows.groupBy("q", "l").agg(*(F.sum(at(v, i)).alias(f"{v}{i}") for v in "rb" for i in range(k)))
    return parts.agg(*(F.sum(F.col(f"{v}{i}") * F.col(f"{v}{i}")).alias(f"{v}{i}") for v in "rb" for i in range(k)))


def lsmr(
    tuples: DataFrame, labels: DataFrame, targets: list[str], scratch: Scratch, kind: str | Action = "map", tol: float = 1e-8, certificate: float | None = 1e-8, most: int = 1000, grouped: bool = True
) -> Run:
    """min |sqrt(W)(y - Bx)| by LSMR (Fong & Saunders, 2011) in the inner product of a preconditioner, for all columns.

    The vector on tuples, u, is never formed: with t = B'W^(1/2)u, the next beta u is A v - alpha u for A = W^(1/2)B, so its square is
    v'Gv - alpha^2 and its t is Gv - alpha t.  A step is one product with the Gramian, and no tuple is written.  A column's
    stop for convergence counts only if its certificate on the tuples is within ``certificate`` (None: no gate); a vetoed column
    goes on where it is.
    """
    k = len(targets)
    _check(k)
    d = scratch.table(degrees(tuples))
    with Columns(tuples, k, scratch, grouped, level_counts(d), labels) as op:
        act = _action(op, labels, d, kind)
        beta = np.sqrt([v or 0.0 for v in tuples.agg(*(F.sum(F.col("w") * F.col(t) * F.col(t)) for t in targets)).first()])
        inverse = lambda v: np.where(v > 0, 1 / np.where(v > 0, v, 1.0), 0.0)

        def level_side(new: DataFrame) -> tuple[DataFrame, np.ndarray]:
            """(q, l, s, t, v) before s and v are made unit, and the new alpha, from (q, l, s, t)."""
            new = scratch.table(new)
            v = act(new.select("q", "l", F.col("s").alias("x"))).withColumnRenamed("x", "v")
            both = scratch.table(new.join(v, ["q", "l"]))
            scratch.drop(new)
            return both, np.sqrt(np.maximum(_dots(both, k, {"a": ("s", "v")})["a"], 0))

        per = inverse(beta)
        start = op.adjoint(tuples, lambda i: F.col("w") * F.col(targets[i]) * F.lit(float(per[i])))
        pair, alpha = level_side(start.select("q", "l", F.col("x").alias("s"), F.col("x").alias("t")))
        stops = ["zero rhs" if a == 0 or b == 0 else "" for a, b in zip(alpha, beta, strict=True)]
        zeta_bar, alpha_bar = alpha * beta, alpha.copy()
        first = zeta_bar.copy()
        rho, rho_bar, c_bar, s_bar = np.ones(k), np.ones(k), np.ones(k), np.zeros(k)
        zero = each(k, lambda i: F.lit(0.0))
        unit = inverse(alpha)
        vectors = scratch.table(pair.select("q", "l", zero.alias("x"), each(k, lambda i: at("v", i) * F.lit(float(unit[i]))).alias("h"), zero.alias("g")))
        iterations, vetoes = [0] * k, [0] * k
        for step in range(1, most + 1):
            open_ = np.array([not s for s in stops])
            if not open_.any():
                break
            v = pair.select("q", "l", each(k, lambda i, unit=unit: at("v", i) * F.lit(float(unit[i]))).alias("x"))
            joined = scratch.table(pair.select("q", "l", "s", "t", "v").join(op.gramian(v).withColumnRenamed("x", "g"), ["q", "l"]))
            curvature = _dots(joined, k, {"c": ("v", "g")})["c"] * unit
            beta = np.where(open_, np.sqrt(np.maximum(curvature - alpha * alpha, 0)), beta)
            scratch.drop(pair)
            per, less = np.where(open_, inverse(beta), 0.0), np.where(open_, beta * unit, 0.0)  # a column that is done has s = t = v = 0
            t = lambda i, per=per, alpha=alpha: F.lit(float(per[i])) * (at("g", i) - F.lit(float(alpha[i])) * at("t", i))
            s = lambda i, t=t, less=less: t(i) - F.lit(float(less[i])) * at("s", i)
            pair, found = level_side(joined.select("q", "l", each(k, s).alias("s"), each(k, t).alias("t")))
            scratch.drop(joined)
            alpha = np.where(open_, np.where(beta > 0, found, 0.0), alpha)
            rho_old, rho = rho, np.where(open_, np.hypot(alpha_bar, beta), rho)
            c, sn = alpha_bar / rho, beta / rho
            theta, alpha_bar = np.where(open_, sn * alpha, 0.0), np.where(open_, c * alpha, alpha_bar)
            rho_bar_old = rho_bar
            theta_bar, temp = s_bar * rho, c_bar * rho
            rho_bar = np.where(open_, np.hypot(temp, theta), rho_bar)
            c_bar, s_bar = np.where(open_, temp / rho_bar, c_bar), np.where(open_, theta / rho_bar, s_bar)
            zeta, zeta_bar = c_bar * zeta_bar, np.where(open_, -s_bar * zeta_bar, zeta_bar)
            unit = inverse(alpha)
            f1, f2 = np.where(open_, -theta_bar * rho / (rho_old * rho_bar_old), 0.0), np.where(open_, zeta / (rho * rho_bar), 0.0)
            f3 = np.where(open_, -theta / rho, 0.0)
            rows = vectors.join(pair.select("q", "l", "v"), ["q", "l"])
            g = each(k, lambda i, f1=f1: at("h", i) + F.lit(float(f1[i])) * at("g", i))
            rows = rows.withColumn("g", g)  # a column that is done keeps x, as its f2 is 0
            rows = rows.select("q", "l", _plus(k, "x", f2, "g").alias("x"), each(k, lambda i, f3=f3, unit=unit: at("v", i) * F.lit(float(unit[i])) + F.lit(float(f3[i])) * at("h", i)).alias("h"), "g")
            before, vectors = vectors, scratch.table(rows)
            scratch.drop(before)
            size = np.abs(zeta_bar)
            ready = open_ & ((size <= tol * first) | (alpha == 0) | (beta == 0))
            allowed = ready
            if ready.any() and certificate is not None:
                ratio = certificates(tuples, op.project(vectors.select("q", "l", "x"), labels), targets, scratch)
                allowed = ready & (ratio <= certificate)
            for i in np.flatnonzero(open_):
                iterations[i] = step
                exact = alpha[i] == 0 or beta[i] == 0
                if exact:
                    stops[i] = "exact breakdown" if allowed[i] else "refused breakdown"
                elif allowed[i]:
                    stops[i] = "converged"
                elif ready[i]:
                    vetoes[i] += 1
                    if size[i] <= np.finfo(float).eps ** 2 * first[i]:
                        stops[i] = "stagnated"
        stops = [s or "iteration limit" for s in stops]
        return Run(scratch.table(op.project(vectors.select("q", "l", "x"), labels)), iterations, stops, vetoes)
