"""Screening of aggregation maps on tables: compatible relaxation, witness-driven split repair, cycle probes, hierarchy plans.

All vectors of a probe are the columns of one array, so a sweep costs the jobs of one vector.  Start vectors are hashes of
(factor, level, vector, seed), the same on any number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators.candidates import learned_scores, matching_map, neighborhood_candidates, signature_pairs
from triweave.operators.columns import Columns, at, each, level_counts, sums
from triweave.operators.linear import degrees
from triweave.operators.transfer import Hierarchy
from triweave.plans.scratch import Scratch

VECTORS, SWEEPS, STARTS, STEPS, TAIL = 8, 8, 8, 16, 4
#: Fixed values of the gates: greatest coarse share of levels, least share of tuples merged, greatest two-level complexity,
#: greatest compatible factor, cumulative complexities of a plan by levels and tuples, levels at which a plan ends.
DIMENSION_RATIO, TUPLE_REDUCTION, COMPLEXITY, FACTOR, PLAN_DIMENSION, PLAN_TUPLES, PLAN_TERMINAL = 0.75, 0.02, 1.98, 0.7, 2.5, 3.0, 192

Smoother = Callable[[DataFrame], DataFrame]


def start_vectors(levels: DataFrame, k: int, seed: int) -> DataFrame:
    """(q, l, x): ``k`` numbers in [-1, 1) for each level."""
    unit = lambda i: F.pmod(F.xxhash64("q", "l", F.lit(i), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 51) - 1.0
    return levels.select("q", "l", each(k, unit).alias("x"))


def jacobi(op: Columns, d: DataFrame, omega: float = 0.5) -> Smoother:
    return lambda r: r.join(d, ["q", "l"]).select("q", "l", each(op.k, lambda i: F.lit(omega) * at("x", i) / F.col("d")).alias("x"))


def compatible(x: DataFrame, d: DataFrame, m: DataFrame, k: int) -> DataFrame:
    """(q, l, x) less the degree-weighted means of the aggregates, column by column."""
    own = x.join(d, ["q", "l"]).join(m, ["q", "l"])
    means = own.groupBy("q", "parent").agg(sums(k, lambda i: F.col("d") * at("x", i)).alias("_s"), F.sum("d").alias("_d"))
    return own.join(means, ["q", "parent"]).select("q", "l", each(k, lambda i: at("x", i) - at("_s", i) / F.col("_d")).alias("x"))


def _norms(rows: DataFrame, k: int, f: Callable[[int], Column]) -> np.ndarray:
    row = rows.agg(*(F.sum(f(i)).alias(f"n{i}") for i in range(k))).first()
    return np.sqrt(np.maximum([row[f"n{i}"] or 0.0 for i in range(k)], 0))


@dataclass
class Relaxation:
    """Of each start vector the contraction a sweep; the slowest one's factor, what it ends as (q, l, x), and the largest
    weighted sum of an aggregate in it, which should be 0."""

    factors: list[float]
    factor: float
    witness: DataFrame
    coarse_defect: float

    def accepted(self, factor: float = FACTOR, defect: float = 1e-8) -> bool:
        return self.factor <= factor and self.coarse_defect <= defect


def compatible_relaxation(tuples: DataFrame, m: DataFrame, scratch: Scratch, vectors: int = VECTORS, sweeps: int = SWEEPS, seed: int = 2, smoother: Callable[[Columns, DataFrame], Smoother] = jacobi) -> Relaxation:
    """How fast the smoother contracts, in the D-norm, what the aggregates of ``m`` can't hold."""
    d = scratch.table(degrees(tuples))
    with Columns(tuples, vectors, scratch, True, level_counts(d)) as op:
        smooth = smoother(op, d)
        size = lambda x: _norms(x.join(d, ["q", "l"]), vectors, lambda i: F.col("d") * at("x", i) * at("x", i))
        x = scratch.table(compatible(start_vectors(m, vectors, seed), d, m, vectors))
        before = size(x)
        for _ in range(sweeps):
            z = smooth(scratch.table(op.gramian(x))).withColumnRenamed("x", "z")
            moved = x.join(z, ["q", "l"]).select("q", "l", each(vectors, lambda i: at("x", i) - at("z", i)).alias("x"))
            last, x = x, scratch.table(compatible(moved, d, m, vectors))
            scratch.drop(last)
        factors = np.where(before > 1e-12, (size(x) / np.where(before > 0, before, 1.0)) ** (1 / sweeps), 0.0)
        worst = int(np.argmax(factors))
        witness = scratch.table(x.select("q", "l", at("x", worst).alias("x")))
        held = witness.join(d, ["q", "l"]).join(m, ["q", "l"]).groupBy("q", "parent").agg(F.sum(F.col("d") * F.col("x")).alias("s"))
        return Relaxation(factors.tolist(), float(factors[worst]), witness, held.agg(F.max(F.abs("s"))).first()[0] or 0.0)


def test_vectors(tuples: DataFrame, labels: DataFrame, scratch: Scratch, k: int = VECTORS, sweeps: int = SWEEPS, seed: int = 1) -> DataFrame:
    """(q, l, x): smooth vectors in the range of G: hashes, times G, then Jacobi sweeps on Gx = 0, of D-norm one."""
    d = scratch.table(degrees(tuples))
    with Columns(tuples, k, scratch, True, level_counts(d)) as op:
        smooth = jacobi(op, d)
        x = scratch.table(op.project(op.gramian(start_vectors(labels, k, seed)), labels))
        for _ in range(sweeps):
            z = smooth(scratch.table(op.gramian(x))).withColumnRenamed("x", "z")
            last, x = x, scratch.table(op.project(x.join(z, ["q", "l"]).select("q", "l", each(k, lambda i: at("x", i) - at("z", i)).alias("x")), labels))
            scratch.drop(last)
        size = _norms(x.join(d, ["q", "l"]), k, lambda i: F.col("d") * at("x", i) * at("x", i))
        per = np.where(size > 0, 1 / np.where(size > 0, size, 1.0), 0.0)
        return scratch.table(x.select("q", "l", each(k, lambda i: at("x", i) * F.lit(float(per[i]))).alias("x")))


def learned_map(tuples: DataFrame, labels: DataFrame, scratch: Scratch, rounds: int = 2, factor: float = FACTOR, k: int = VECTORS) -> tuple[DataFrame, Relaxation]:
    """A map by greedy matching of learned scores, and its relaxation; the slowest witness joins the vectors until the map is
    accepted or ``rounds`` are over."""
    d = scratch.table(degrees(tuples))
    structural = scratch.table(neighborhood_candidates(tuples))
    x = test_vectors(tuples, labels, scratch, k)
    for r in range(rounds):
        near = scratch.table(signature_pairs(x, labels, k + r, scratch))
        m = scratch.table(matching_map(scratch.table(learned_scores(structural, near, x, d, k + r)), labels, scratch))
        relaxed = compatible_relaxation(tuples, m, scratch, k)
        if relaxed.accepted(factor) or r + 1 == rounds:
            break
        size = _norms(relaxed.witness.join(d, ["q", "l"]).select("d", F.array("x").alias("x")), 1, lambda i: F.col("d") * at("x", i) * at("x", i))[0] or 1.0
        more = relaxed.witness.select("q", "l", F.array(F.col("x") / F.lit(float(size))).alias("y"))
        x = scratch.table(x.join(more, ["q", "l"]).select("q", "l", F.concat("x", "y").alias("x")))
    return m, relaxed


def split_repair(m: DataFrame, witness: DataFrame, d: DataFrame) -> DataFrame:
    """``m`` with the aggregate split in two that holds most D-energy of the witness about its mean: at the largest gap
    between its levels in order of the witness (ties: the first).  The new aggregate gets the next number of its factor."""
    own = m.join(witness, ["q", "l"]).join(d, ["q", "l"])
    means = own.groupBy("q", "parent").agg((F.sum(F.col("d") * F.col("x")) / F.sum("d")).alias("mean"), F.count("*").alias("n"))
    off = F.col("x") - F.col("mean")
    energy = own.join(means, ["q", "parent"]).groupBy("q", "parent").agg(F.sum(F.col("d") * off * off).alias("energy"), F.max("n").alias("n"))
    worst = energy.where("n > 1 AND energy > 0").orderBy(F.desc("energy"), "q", "parent").limit(1).collect()
    if not worst:
        return m
    q, parent = worst[0].q, worst[0].parent
    inside = own.where((F.col("q") == q) & (F.col("parent") == parent))
    gap = F.col("x") - F.lag("x").over(W.partitionBy("q").orderBy("x", "l"))  # one aggregate's levels
    cut = inside.withColumn("gap", gap).where("gap IS NOT NULL").orderBy(F.desc("gap"), "x", "l").limit(1).collect()[0]
    after = inside.where((F.col("x") > cut.x) | ((F.col("x") == cut.x) & (F.col("l") >= cut.l))).select("q", "l", F.lit(True).alias("after"))
    fresh = m.where(F.col("q") == q).agg(F.max("parent")).first()[0] + 1
    return m.join(after, ["q", "l"], "left").select("q", "l", F.when(F.col("after"), F.lit(fresh)).otherwise(F.col("parent")).cast("int").alias("parent"))


def cycle_probe(tuples: DataFrame, labels: DataFrame, action: Smoother, scratch: Scratch, starts: int = STARTS, steps: int = STEPS, tail: int = TAIL, seed: int = 3) -> float:
    """The estimated energy-norm factor of I - MG by power iteration on ``starts`` columns: the greatest geometric mean of the last factors."""
    with Columns(tuples, starts, scratch, True, level_counts(labels)) as op:
        x = scratch.table(op.project(start_vectors(labels, starts, seed), labels))
        energy = lambda x, gx: _norms(x.join(gx.withColumnRenamed("x", "gx"), ["q", "l"]), starts, lambda i: at("x", i) * at("gx", i))
        gx = scratch.table(op.gramian(x))
        size, logs = energy(x, gx), []
        for _ in range(steps):
            per = np.where(size > 0, 1 / np.where(size > 0, size, 1.0), 0.0)
            scaled = scratch.table(gx.select("q", "l", each(starts, lambda i, per=per: at("x", i) * F.lit(float(per[i]))).alias("x")))
            moved = x.join(action(scaled).withColumnRenamed("x", "z"), ["q", "l"]).select("q", "l", each(starts, lambda i, per=per: at("x", i) * F.lit(float(per[i])) - at("z", i)).alias("x"))
            last, x = x, scratch.table(op.project(moved, labels))
            scratch.drop(last)
            gx = scratch.table(op.gramian(x))
            size = energy(x, gx)
            logs.append(np.log(np.maximum(size, 1e-300)))
        return float(np.exp(np.mean(logs[-tail:], axis=0).max()))


def structural_gate(levels: int, tuples: int, coarse_levels: int, coarse_tuples: int) -> dict[str, float | bool]:
    """Counts of two levels against the gates."""
    m = {"dimension_ratio": coarse_levels / levels, "tuple_reduction": 1 - coarse_tuples / tuples, "complexity": 1 + coarse_tuples / tuples}
    return m | {"accepted": m["dimension_ratio"] <= DIMENSION_RATIO and m["tuple_reduction"] >= TUPLE_REDUCTION and m["complexity"] <= COMPLEXITY}


@dataclass
class Plan:
    """A hierarchy, why its building stopped, and what each tried level measured."""

    hierarchy: Hierarchy
    stop: str = ""
    trials: list[dict] = field(default_factory=list)


def plan_hierarchy(
    tuples: DataFrame, labels: DataFrame, scratch: Scratch, terminal: int = PLAN_TERMINAL, repairs: int = 1, factor: float = FACTOR, vectors: int = 4, learned: bool = False
) -> Plan:
    """Levels by greedy matching of neighbours, or of ``learned`` scores, each admitted by the structural gates, the compatible gate, after at most
    ``repairs`` witness splits, and the plan's cumulative complexities.

    Stops: ``terminal reached``, ``structural gate``, ``compatible gate``, ``dimension complexity``, ``tuple complexity``.
    """
    plan = Plan(Hierarchy(tuples, labels, scratch))
    h = plan.hierarchy
    dims = [h.labels[0].count()]
    while dims[-1] > terminal:
        fine = h.levels[-1]
        if learned:
            m, relaxed = learned_map(fine, h.labels[-1], scratch, factor=factor, k=vectors)
        else:
            m = scratch.table(matching_map(scratch.table(neighborhood_candidates(fine)), h.labels[-1], scratch))
            relaxed = compatible_relaxation(fine, m, scratch, vectors)
        splits = 0
        while not relaxed.accepted(factor) and splits < repairs:
            m = scratch.table(split_repair(m, relaxed.witness, scratch.table(degrees(fine))))
            relaxed, splits = compatible_relaxation(fine, m, scratch, vectors), splits + 1
        trial = {"factor": relaxed.factor, "splits": splits}
        plan.trials.append(trial)
        try:
            h.append(m)
        except ModelError as e:
            if e.code != "no reduction":
                raise
            plan.stop = "structural gate"
            return plan
        dims.append(h.labels[-1].count())
        trial |= structural_gate(dims[-2], h.sizes[-2], dims[-1], h.sizes[-1])
        refused = (
            "structural gate" if not trial["accepted"] else "compatible gate" if not relaxed.accepted(factor)
            else "dimension complexity" if sum(dims) > PLAN_DIMENSION * dims[0] else "tuple complexity" if h.tuple_complexity > PLAN_TUPLES else ""
        )
        if refused:
            h.drop_last()
            plan.stop = refused
            return plan
    plan.stop = "terminal reached"
    return plan
