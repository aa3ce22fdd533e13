"""Aggregation maps (q, l, parent): prolongation, restriction, Galerkin coarsening and weight replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.model import ModelError
from triweave.operators.encode import CODES
from triweave.operators.exact import exact_sums, refuse_overflow
from triweave.plans.scratch import Scratch


def identity_map(levels: DataFrame) -> DataFrame:
    return levels.select("q", "l", F.col("l").alias("parent"))


def halving_map(levels: DataFrame) -> DataFrame:
    return levels.select("q", "l", F.floor(F.col("l") / 2).cast("int").alias("parent"))


def validate_map(m: DataFrame, labels: DataFrame | None = None) -> None:
    """Refuses gaps among parents and, with labels, aggregates across components."""
    gaps = m.groupBy("q").agg((F.max("parent") + 1).alias("n"), F.count_distinct("parent").alias("k"), F.min("parent").alias("lo")).where("n <> k OR lo < 0")
    if not gaps.isEmpty():
        raise ModelError("empty aggregate")
    if labels is not None and not m.join(labels, ["q", "l"]).groupBy("q", "parent").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").isEmpty():
        raise ModelError("aggregate crosses components")


def prolong(m: DataFrame, coarse: DataFrame) -> DataFrame:
    """(q, l, x) from (q, l = parent, x)."""
    return m.join(coarse.withColumnRenamed("l", "parent"), ["q", "parent"]).select("q", "l", "x")


def prolong_add(m: DataFrame, coarse: DataFrame, fine: DataFrame) -> DataFrame:
    return fine.join(prolong(m, coarse).withColumnRenamed("x", "p"), ["q", "l"], "left").select("q", "l", (F.col("x") + F.coalesce("p", F.lit(0))).alias("x"))


def restrict(m: DataFrame, fine: DataFrame) -> DataFrame:
    """P'r as (q, l = parent, x)."""
    return m.join(fine, ["q", "l"]).groupBy("q", F.col("parent").alias("l")).agg(F.sum("x").alias("x"))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The map that leads through ``first`` and ``then``; by it, tuples are coarsened twice in one shuffle."""
    return first.join(then.select("q", F.col("l").alias("parent"), F.col("parent").alias("_p")), ["q", "parent"]).select("q", "l", F.col("_p").alias("parent"))


def mapped(tuples: DataFrame, m: DataFrame) -> DataFrame:
    """``tuples`` with parents pa, pb, pc."""
    side = lambda q: m.where(F.col("q") == q).select(F.col("l").alias(CODES[q]), F.col("parent").alias(f"p{CODES[q]}"))
    return reduce(lambda t, q: t.join(side(q), CODES[q]), range(3), tuples)


def coarsen(tuples: DataFrame, m: DataFrame) -> DataFrame:
    """(a, b, c, w) of the Galerkin product P'GP: mapped tuples, equal ones merged."""
    return mapped(tuples, m).groupBy(*(F.col(f"p{c}").alias(c) for c in CODES)).agg(F.sum("w").alias("w"))


def coarse_map(tuples: DataFrame, m: DataFrame, coarse_tuples: DataFrame) -> DataFrame:
    """(tid, ctid): the weights-free merge plan."""
    return mapped(tuples, m).join(coarse_tuples.select(F.col("tid").alias("ctid"), *(F.col(c).alias(f"p{c}") for c in CODES)), [f"p{c}" for c in CODES]).select("tid", "ctid")


def replay(weights: DataFrame, plan: DataFrame) -> DataFrame:
    """(ctid, w): another generation of weights through a stored plan."""
    return weights.select("tid", "w").join(plan, "tid").groupBy("ctid").agg(F.sum("w").alias("w"))


def exact_replay(weights: DataFrame, plan: DataFrame) -> DataFrame:
    """``replay`` by exact sums, rounded once; a sum beyond the doubles is infinite, which ``exact.refuse_overflow`` refuses."""
    return exact_sums(weights.select("tid", "w").join(plan, "tid"), ["ctid"], {"w": F.col("w")}).select("ctid", "w")


def replay_levels(weights: DataFrame, plans: list[DataFrame]) -> list[DataFrame]:
    """(tid, w) of every level, finest first: one generation of weights through all plans of a hierarchy."""
    frames = [weights.select("tid", "w")]
    for plan in plans:
        frames.append(replay(frames[-1], plan).withColumnRenamed("ctid", "tid"))
    return frames


class Hierarchy:
    """Levels of tuples, maps and merge plans without weights' history, each a table in the shared folder.

    levels[i] (tid, a, b, c, w), labels[i] (q, l, component) with the same components on every level; maps[i]
    (q, l, parent) and plans[i] (tid, ctid) lead from level i to i + 1.  A refused level leaves those before it.
    ``planned=False``, for cycles that replay no weights: no plans, coarse tuples without numbers in their order, and
    ``tuples``, a table already, as the first level.
    """

    def __init__(self, tuples: DataFrame, labels: DataFrame, scratch: Scratch, max_levels: int = 64, max_tuples: int | None = None, strict: bool = True, planned: bool = True):
        self.scratch, self.planned = scratch, planned
        self.levels = [scratch.table(tuples.select("tid", *CODES, "w")) if planned else tuples]
        self.labels = [scratch.table(labels.select("q", "l", "component"))]
        self.maps, self.plans, self.max_levels, self.max_tuples, self.strict = [], [], max_levels, max_tuples, strict
        self.sizes = [self.levels[0].count()]

    def append(self, m: DataFrame) -> DataFrame:
        """Coarsens the last level by a map, which must cover its levels, leave no gap and cross no component."""
        if len(self.levels) >= self.max_levels:
            raise ModelError("too many levels")
        m = self.scratch.table(m.select("q", "l", "parent"))
        if not self.labels[-1].join(m, ["q", "l"], "left_anti").isEmpty():
            raise ModelError("level without aggregate")
        validate_map(m, self.labels[-1])
        coarse = coarsen(self.levels[-1], m)
        coarse = numbered(coarse, list(CODES), "tid", scratch=self.scratch) if self.planned else coarse.withColumn("tid", F.monotonically_increasing_id())
        coarse = self.scratch.table(coarse.select("tid", *CODES, "w"))
        n = coarse.count()
        if self.strict and n >= self.sizes[-1]:
            raise ModelError("no reduction")
        if self.max_tuples is not None and sum(self.sizes) + n > self.max_tuples:
            raise ModelError("too many tuples")
        if self.planned:
            self.plans.append(self.scratch.table(coarse_map(self.levels[-1], m, coarse)))
        self.labels.append(self.scratch.table(m.join(self.labels[-1], ["q", "l"]).select("q", F.col("parent").alias("l"), "component").distinct()))
        self.levels.append(coarse)
        self.maps.append(m)
        self.sizes.append(n)
        return coarse

    def drop_last(self) -> None:
        """Takes the last level back."""
        if not self.plans:
            raise ModelError("no transition")
        for kept in (self.levels, self.labels, self.maps, self.plans, self.sizes):
            kept.pop()

    def replay(self, weights: DataFrame, exact: bool = False) -> list[DataFrame]:
        """(tid, w) of every level, finest first, for one generation of weights (tid, w) of the finest."""
        frames = [weights.select("tid", "w")]
        for i in range(len(self.plans)):
            frames.append(self.scratch.table(self.step(frames[-1], i, exact)))
        return frames

    def provisional(self, weights: DataFrame, exact: bool = True) -> DataFrame:
        """(tid, w) of the last level from weights of the level before it: the latest transition alone."""
        if not self.plans:
            raise ModelError("no transition")
        return self.step(weights, len(self.plans) - 1, exact)

    def step(self, weights: DataFrame, i: int, exact: bool) -> DataFrame:
        made = (exact_replay if exact else replay)(weights, self.plans[i]).withColumnRenamed("ctid", "tid")
        return refuse_overflow(self.scratch.table(made), ["w"], "coarse tuple total") if exact else made

    @property
    def tuple_complexity(self) -> float:
        return sum(self.sizes) / self.sizes[0]
