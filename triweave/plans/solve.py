"""Certified least squares, component by component, with a global fallback.

Route of a component by its size: one tuple: a third of its target to each level, as an expression; up to ``dense_most``
levels: dense pseudoinverse; up to ``task_tuples`` tuples: gated LSMR in one task with a screened hierarchy, else a fixed
preconditioner; beyond: by a V-cycle on tables (``plans.batch``, all columns at once) straight to a terminal size where two of
the factors are small enough to stay whole; else up to ``plain_tuples`` tuples in one task by a fixed preconditioner, and beyond by
the diagonal on tables.  Small components go to
tasks in packs of about PACK tuples, those of one shape through one stacked pseudoinverse.  Each column is then certified on
the original problem; only those above the tolerance are solved again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.local import actions
from triweave.local.coarsening import screened_hierarchy
from triweave.local.dense import Pseudoinverse
from triweave.local.problem import Local
from triweave.local.solvers import gated_lsmr, pcg
from triweave.model import ModelError
from triweave.operators import components as comp
from triweave.operators import linear
from triweave.operators.columns import Columns, at, level_counts
from triweave.operators.transfer import Hierarchy
from triweave.plans import batch, multilevel
from triweave.plans.scratch import Scratch

BASELINES = {"identity": lambda p: actions.projected(p, actions.identity(p)), "diagonal": actions.diagonal, "map": actions.symmetric_map, "pair_schwarz": actions.pair_schwarz}
COEF_SCHEMA = "q int, l int, k int, x double, component int, route string, iterations int, native_converged boolean"
MOST_TARGETS = batch.MOST_COLUMNS
#: Tuples of a pack of components; levels and tuples of a component that is solved in a stack.
PACK, STACK_LEVELS, STACK_TUPLES = 20_000, 24, 64


@dataclass(frozen=True)
class Options:
    method: str = "automatic"  # or lsmr, pcg
    baseline: str = "map"
    tolerance: float = 1e-10
    iterations: int = 2000
    dense_most: int = 256
    task_tuples: int = 400_000  # about 2 kB each at the peak, in a hierarchy's affinities
    plain_tuples: int = 1_000_000  # as many may go to a task in the method automatic without a hierarchy; with task_tuples 0, none
    table_hierarchy: int = 400_000  # tuples on tables beyond which the method automatic tries a hierarchy, which costs jobs


def solve_local(p: Local, targets: np.ndarray, options: Options) -> tuple[np.ndarray, str, list[int], list[bool]]:
    """(coefficients by target, route, iterations, native convergence) of one component."""
    k = targets.shape[1]
    if options.method == "automatic":
        if len(p.w) == 1:
            return np.repeat(targets / 3, 3, axis=0), "singleton", [0] * k, [True] * k
        if p.dim <= options.dense_most:
            solve = Pseudoinverse(p.dense())
            return np.column_stack([p.project(solve(p.rhs(targets[:, j]))) for j in range(k)]), "dense", [0] * k, [True] * k
        h = screened_hierarchy(p) if len(p.w) <= options.task_tuples else None
        action, route = (h, "hierarchy") if h is not None else (BASELINES[options.baseline](p), options.baseline)
    else:
        action, route = BASELINES[options.baseline](p), f"{options.method}:{options.baseline}"
    xs, its, native = [], [], []
    for j in range(k):
        if options.method == "pcg":
            out = pcg(p, p.rhs(targets[:, j]), action, options.tolerance, most=options.iterations)
        else:
            out, _ = gated_lsmr(p, targets[:, j], action, options.tolerance, options.iterations)
        xs.append(p.project(out.x))
        its.append(out.iterations)
        native.append(out.converged)
    return np.column_stack(xs), route, its, native


def _coefficients(levels: list[np.ndarray], x: np.ndarray, component: int, route: str, its: list[int], native: list[bool]) -> pd.DataFrame:
    q, level = np.repeat(np.arange(3), [len(v) for v in levels]), np.concatenate(levels)
    k = x.shape[1]
    many = {"k": np.repeat(np.arange(k), len(q)), "x": x.T.ravel(), "iterations": np.repeat(its, len(q)), "native_converged": np.repeat(native, len(q))}
    return pd.DataFrame({"q": np.tile(q, k), "l": np.tile(level, k), "component": component, "route": route} | many)


def _alone(frame: pd.DataFrame, targets: list[str], options: Options) -> pd.DataFrame:
    levels, codes = zip(*(np.unique(frame[c], return_inverse=True) for c in ("a", "b", "c")), strict=True)
    p = Local(np.column_stack(codes), frame["w"].to_numpy(), tuple(map(len, levels)))
    y = frame[targets].to_numpy(float)
    try:
        x, route, its, native = solve_local(p, y, options)
    except ModelError as e:  # the fallback decides
        x, route, its, native = np.zeros((p.dim, y.shape[1])), f"failed: {e.code}", [0] * y.shape[1], [False] * y.shape[1]
    return _coefficients(list(levels), x, frame["component"].iloc[0], route, its, native)


def _stacked(frame: pd.DataFrame, targets: list[str], starts: np.ndarray, t: int) -> pd.DataFrame:
    """The components of ``t`` tuples each that start at ``starts``: minimum-norm solutions by stacked pseudoinverses."""
    rows = starts[:, None] + np.arange(t)
    codes = frame[["a", "b", "c"]].to_numpy()[rows]  # component, tuple, factor
    order = np.sort(codes, axis=1)
    new = np.concatenate((np.ones((len(starts), 1, 3), bool), order[:, 1:] != order[:, :-1]), axis=1)
    local = (new[:, None] & (order[:, None] < codes[:, :, None])).sum(axis=2)  # smaller levels of the component and factor
    root, y = np.sqrt(frame["w"].to_numpy()[rows])[..., None], frame[targets].to_numpy(float)[rows]
    b = np.zeros((len(starts), t, 3, t))
    np.put_along_axis(b, local[..., None], 1.0, axis=3)
    x = np.linalg.pinv((b * root[..., None]).reshape(len(starts), t, 3 * t)) @ (y * root)
    x = x.reshape(len(starts), 3, t, -1)
    level = np.zeros((len(starts), 3, t), codes.dtype)
    np.put_along_axis(level, np.moveaxis(local, 1, 2), np.moveaxis(codes, 1, 2), axis=2)
    used = np.arange(t) < new.sum(axis=1)[..., None]
    m, q, i = np.nonzero(used)
    k = len(targets)
    many = {"q": q, "l": level[m, q, i], "component": frame["component"].to_numpy()[starts][m]}
    return pd.DataFrame({name: np.tile(v, k) for name, v in many.items()} | {"k": np.repeat(np.arange(k), len(m)), "x": x[m, q, i].T.ravel(), "route": "dense", "iterations": 0, "native_converged": True})


def _task(targets: list[str], options: Options):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["component", "tid"], kind="stable", ignore_index=True)
        starts = np.flatnonzero(np.diff(frame["component"], prepend=-1))
        sizes = np.diff(starts, append=len(frame))
        stack = (3 * sizes <= min(STACK_LEVELS, options.dense_most)) & (sizes <= STACK_TUPLES) & (options.method == "automatic")
        parts = [_stacked(frame, targets, starts[stack & (sizes == t)], int(t)) for t in np.unique(sizes[stack])]
        parts += [_alone(frame.iloc[a : a + n], targets, options) for a, n in zip(starts[~stack], sizes[~stack], strict=True)]
        return pd.concat(parts)[["q", "l", "k", "x", "component", "route", "iterations", "native_converged"]].astype({"q": "int32", "l": "int32", "k": "int32", "component": "int32", "iterations": "int32"})

    return run


def component_tuples(tuples: DataFrame, own: DataFrame) -> DataFrame:
    """(component, n): how many tuples each has, from counts by first level, so that no tuple is joined; ``own``: (a, component)."""
    return tuples.groupBy("a").agg(F.count("*").alias("n")).join(own, "a").groupBy("component").agg(F.sum("n").alias("n"))


def solve_components(tuples: DataFrame, labels: DataFrame, targets: list[str], options: Options = Options()) -> DataFrame:
    """Coefficients (COEF_SCHEMA) of all components that fit a task: tuples (tid, a, b, c, w, targets)."""
    if not 1 <= len(targets) <= MOST_TARGETS:
        raise ModelError("number of targets", str(len(targets)))
    own_a = labels.where("q = 0").select(F.col("l").alias("a"), "component")
    sizes = component_tuples(tuples, own_a)
    own = tuples.select("tid", "a", "b", "c", "w", *targets).join(own_a, "a")
    packs = max(1, -(-tuples.count() // PACK))
    # a large component is a pack of its own; small ones share packs by hash
    pack = F.when(F.col("n") > PACK // 2, -1 - F.col("component").cast("long")).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs)))
    return own.join(sizes.select("component", pack.alias("pack")), "component").groupBy("pack").applyInPandas(_task(targets, options), COEF_SCHEMA)


def singleton_solution(tuples: DataFrame, labels: DataFrame, targets: list[str]) -> DataFrame:
    """Coefficients of the components of one tuple, without Python: y/3 to each of its levels."""
    own = tuples.join(labels.where("q = 0").select(F.col("l").alias("a"), "component"), "a")
    single = own.groupBy("component").agg(F.count("*").alias("n")).where("n = 1").select("component")
    rows = own.join(single, "component").select("component", F.posexplode(F.array("a", "b", "c")).alias("q", "l"), F.array(*targets).alias("ys"))
    return rows.select("component", "q", "l", F.posexplode("ys").alias("k", "y")).select("q", "l", "k", (F.col("y") / 3).alias("x"), "component")


def distributed_pcg(tuples: DataFrame, labels: DataFrame, target: str, scratch: Scratch, rel: float = 1e-8, most: int = 200) -> tuple[DataFrame, int, bool]:
    """(coefficients (q, l, x), iterations, whether the residual fell below ``rel``): one column by ``batch.pcg`` with the diagonal."""
    run = batch.pcg(tuples, labels, [target], scratch, "diagonal", rel, most)
    return run.coefficients.select("q", "l", at("x", 0).alias("x")), run.iterations[0], run.converged[0]


def solve_tables(tuples: DataFrame, labels: DataFrame, targets: list[str], scratch: Scratch, options: Options, route: str = "distributed", m: DataFrame | None = None) -> DataFrame:
    """Coefficients (COEF_SCHEMA) of components beyond a task, all columns at once: gated LSMR for the method ``lsmr``, else
    conjugate gradients.  By the diagonal, as in the method ``automatic``, whose steps cost a quarter of a sweep's, or,
    where a method is named and neither diagonal nor identity is its baseline, by sweeps over the factors.  With a map ``m`` to a
    terminal size: conjugate gradients by its V-cycle."""
    if m is not None:
        h = Hierarchy(tuples, labels, scratch, planned=False)
        h.append(m)
        k = len(targets)
        with Columns(tuples, k, scratch, True, level_counts(labels), labels) as op, multilevel.VCycle(h, k, scratch, finest=op) as cycle:
            return _table_rows(batch.pcg(tuples, labels, targets, scratch, cycle, options.tolerance, options.iterations, shared=op), labels, "hierarchy")
    kind = "diagonal" if options.method == "automatic" or options.baseline in ("diagonal", "identity") else "map"
    if options.method == "lsmr":
        run = batch.lsmr(tuples, labels, targets, scratch, kind, options.tolerance, options.tolerance * 10, options.iterations)
    else:
        run = batch.pcg(tuples, labels, targets, scratch, kind, options.tolerance, options.iterations)
    return _table_rows(run, labels, route)


def _table_rows(run: batch.Run, labels: DataFrame, route: str) -> DataFrame:
    """COEF_SCHEMA of a run on tables."""
    known = [F.struct(F.lit(i).alias("k"), at("x", i).alias("x"), F.lit(n).alias("iterations"), F.lit(met).alias("met")) for i, (n, met) in enumerate(zip(run.iterations, run.converged, strict=True))]
    rows = run.coefficients.join(labels, ["q", "l"]).select(F.col("q").cast("int").alias("q"), F.col("l").cast("int").alias("l"), "component", F.explode(F.array(*known)).alias("e"))
    return rows.select("q", "l", "e.k", "e.x", F.col("component").cast("int").alias("component"), F.lit(route).alias("route"), "e.iterations", F.col("e.met").alias("native_converged"))


def certify(tuples: DataFrame, coefficients: DataFrame, targets: list[str]) -> DataFrame:
    """(k, residual_norm, rhs_norm, ratio) of every column, in one job; ratio is null where a tuple lacks a coefficient."""
    n = len(targets)
    x = coefficients.groupBy("q", "l").agg(F.array(*(F.max(F.when(F.col("k") == i, F.col("x"))) for i in range(n))).alias("x"))
    sums = batch.certificate_sums(tuples, x, targets, None)
    each = F.array(*(F.struct(F.lit(i).alias("k"), F.sqrt(f"r{i}").alias("residual_norm"), F.sqrt(f"b{i}").alias("rhs_norm"), F.isnan(f"r{i}").alias("lacks")) for i in range(n)))
    norms = sums.select(F.explode(each).alias("e")).select("e.*")
    return norms.select("k", F.when(~F.col("lacks"), F.col("residual_norm")).alias("residual_norm"), "rhs_norm", F.when(F.col("lacks"), F.lit(None)).when(F.col("rhs_norm") > 0, F.col("residual_norm") / F.col("rhs_norm")).when(F.col("residual_norm") == 0, F.lit(0.0)).cast("double").alias("ratio"))


def fit(tuples: DataFrame, labels: DataFrame, targets: list[str], scratch: Scratch, options: Options = Options(), accept: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(coefficients, report): report (k, route counts as text, ratio, accepted, global_fallback) for each column."""
    tuples = scratch.table(tuples)
    labels = scratch.table(labels)
    own = labels.where("q = 0").select(F.col("l").alias("a"), "component")
    sizes = scratch.table(component_tuples(tuples, own))
    automatic = options.method == "automatic"
    kinds = lambda giant: sizes.select("component", F.when(F.lit(automatic) & (F.col("n") == 1), "single").when(giant, "giant").otherwise("task").alias("kind"))
    beyond, m = F.col("n") > options.task_tuples, None
    large = sizes.where(beyond).agg(F.sum("n")).first()[0] or 0
    if automatic and large > options.table_hierarchy:
        m = multilevel.terminal_map(tuples.join(own.join(sizes.where(beyond), "component").select("a"), "a", "left_semi"), labels.join(sizes.where(beyond), "component", "left_semi"), scratch)
        if m is None and options.task_tuples:
            beyond = F.col("n") > max(options.plain_tuples, options.task_tuples)
    sizes = kinds(beyond)
    found = {r.kind for r in sizes.select("kind").distinct().collect()}
    part = lambda kind: (tuples.join(own.join(sizes.where(F.col("kind") == kind), "component").select("a"), "a", "left_semi"), labels.join(sizes.where(F.col("kind") == kind), "component", "left_semi")) if len(found) > 1 else (tuples, labels)
    parts = []
    if "single" in found:
        done = singleton_solution(*part("single"), targets)
        parts.append(done.select(F.col("q").cast("int").alias("q"), F.col("l").cast("int").alias("l"), F.col("k").cast("int").alias("k"), "x", F.col("component").cast("int").alias("component"), F.lit("singleton").alias("route"), F.lit(0).alias("iterations"), F.lit(True).alias("native_converged")))
    if "task" in found:
        parts.append(solve_components(*part("task"), targets, options))
    if "giant" in found:
        large, own_labels = part("giant")
        parts.append(solve_tables(scratch.table(large), scratch.table(own_labels), targets, scratch, options, m=m))
    coefficients = scratch.table(reduce(DataFrame.unionByName, parts))
    certificates = scratch.table(certify(tuples, coefficients, targets))
    failed = [r.k for r in certificates.where(F.col("ratio").isNull() | (F.col("ratio") > accept) | F.isnan("ratio")).collect()]  # at most 32
    if failed:
        again = replace(options, method="pcg", baseline="diagonal", tolerance=min(options.tolerance, accept / 10))
        fallback = solve_tables(tuples, labels, [targets[k] for k in failed], scratch, again, "global")
        fallback = fallback.withColumn("k", F.element_at(F.array(*map(F.lit, failed)), F.col("k") + 1))
        coefficients = scratch.table(coefficients.where(~F.col("k").isin(failed)).unionByName(fallback))
        certificates = scratch.table(certify(tuples, coefficients, targets))
    routes = coefficients.groupBy("k").agg(F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"), F.max("iterations").alias("iterations"))
    report = certificates.join(routes, "k").select("k", "routes", "iterations", "ratio", (F.col("ratio") <= accept).alias("accepted"), F.col("k").isin(failed).alias("global_fallback"))
    return coefficients, report


def fitted_values(tuples: DataFrame, coefficients: DataFrame, k: int = 0) -> DataFrame:
    """(tid, a, b, c, fitted)."""
    x = coefficients.where(F.col("k") == k).select("q", "l", "x")
    return linear.incidence(tuples.select("tid", "a", "b", "c"), x, name="fitted")
