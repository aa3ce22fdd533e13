"""Candidate pairs of levels for aggregation and their matching."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.operators.encode import CODES
from triweave.operators.linear import degrees
from triweave.plans.scratch import Scratch

KEEP, CONTEXT_LEAST, NEIGHBOR_LEAST = 16, 0.15, 0.02
#: Weights of the learned score's parts (algebraic, structural, degree, nearness) and the least score.
LEARNED_WEIGHTS, LEARNED_LEAST = (0.55, 0.25, 0.10, 0.10), 0.35


def _affinities(entries: DataFrame, keys: list[str], mass: DataFrame, keep: int, least: float) -> DataFrame:
    """entries (q, keys, l, w): pairs l < r that share a key, by their overlap over the root of their masses."""
    rank = F.row_number().over(W.partitionBy("q", *keys).orderBy(F.desc("w"), "l"))
    top = entries.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    other = top.select("q", *keys, F.col("l").alias("r"), F.col("w").alias("w2"))
    shared = top.join(other, ["q", *keys]).where("l < r").groupBy("q", "l", "r").agg(F.sum(F.least("w", "w2")).alias("overlap"))
    left, right = mass.withColumnRenamed("d", "m1"), mass.select("q", F.col("l").alias("r"), F.col("d").alias("m2"))
    affinity = F.least(F.greatest(F.col("overlap") / F.sqrt(F.col("m1") * F.col("m2")), F.lit(0.0)), F.lit(1.0))
    return shared.join(left, ["q", "l"]).join(right, ["q", "r"]).withColumn("affinity", affinity).where(F.col("affinity") >= least).select("q", "l", "r", "overlap", "affinity")


def context_candidates(tuples: DataFrame, keep: int = KEEP, least: float = CONTEXT_LEAST) -> DataFrame:
    """Levels that share the pair of the other factors' levels."""
    others = [(1, 2), (0, 2), (0, 1)]
    cells = F.array(*(F.struct(F.lit(q).alias("q"), F.col(CODES[q]).alias("l"), F.col(CODES[i]).alias("c1"), F.col(CODES[j]).alias("c2")) for q, (i, j) in enumerate(others)))
    entries = tuples.select(F.explode(cells).alias("e"), "w").select("e.*", "w")
    return _affinities(entries, ["c1", "c2"], degrees(tuples), keep, least)


def neighbor_entries(tuples: DataFrame) -> DataFrame:
    """(q, side, c, l, w): a level's weight with each neighbour in its two pair marginals."""
    cells = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(p).alias("side"), F.col(CODES[p]).alias("c"), F.col(CODES[q]).alias("l")) for q in range(3) for p in range(3) if p != q))
    return tuples.select(F.explode(cells).alias("e"), "w").groupBy("e.q", "e.side", "e.c", "e.l").agg(F.sum("w").alias("w"))


def neighborhood_candidates(tuples: DataFrame, keep: int = KEEP, least: float = NEIGHBOR_LEAST) -> DataFrame:
    """Levels that share a neighbour in either pair marginal; a level's mass counts in both."""
    mass = degrees(tuples).withColumn("d", 2 * F.col("d"))
    return _affinities(neighbor_entries(tuples), ["side", "c"], mass, keep, least)


def adjacent_candidates(tuples: DataFrame) -> DataFrame:
    """(q, l, r): the 1st and 2nd, 3rd and 4th, ... level of each neighbour's row, heaviest first."""
    row = W.partitionBy("q", "side", "c").orderBy(F.desc("w"), "l")
    placed = neighbor_entries(tuples).select("q", "l", F.lead("l").over(row).alias("next"), F.row_number().over(row).alias("n"))
    return placed.where("n % 2 = 1 AND next IS NOT NULL").select("q", F.least("l", "next").alias("l"), F.greatest("l", "next").alias("r")).distinct()


def signature_pairs(x: DataFrame, labels: DataFrame, k: int, scratch: Scratch, window: int = 3) -> DataFrame:
    """(q, l, r, near): levels within ``window`` places of each other in the order of any of ``k`` vectors (q, l, x array), in one
    component and factor; near is 1 for neighbours and falls by 1/window a place.

    Places are numbers over all rows, so the pairs come from an equi-join and no component is sorted in one task.
    """
    key = ["i", "component", "q"]
    rows = x.join(labels, ["q", "l"]).select(*key[1:], "l", F.posexplode("x").alias("i", "v"))
    placed = scratch.table(numbered(rows.select(*key, "v", "l"), [*key, "v", "l"], "n", scratch=scratch).select(*key, "l", "n"))
    ahead = placed.select(*key, "l", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("step"), F.col("n")).withColumn("n", F.col("n") + F.col("step"))
    pairs = ahead.join(placed.withColumnRenamed("l", "other"), [*key, "n"])
    near = F.lit(1.0) - (F.min("step") - 1) / F.lit(window)
    return pairs.groupBy("q", F.least("l", "other").alias("l"), F.greatest("l", "other").alias("r")).agg(near.alias("near"))


def learned_scores(structural: DataFrame, near: DataFrame, x: DataFrame, d: DataFrame, k: int, least: float = LEARNED_LEAST) -> DataFrame:
    """(q, l, r, affinity): candidates by structure or by nearness, scored by how nearly the vectors' values are in one ratio, by
    structural affinity, by the ratio of degrees and by nearness."""
    pool = structural.select("q", "l", "r", "affinity").join(near, ["q", "l", "r"], "full_outer")
    ends = x.join(d, ["q", "l"])
    pool = pool.join(ends.withColumnsRenamed({"x": "xa", "d": "da"}), ["q", "l"]).join(ends.withColumnsRenamed({"l": "r", "x": "xb", "d": "db"}), ["q", "r"])
    dot = lambda u, v: reduce(Column.__add__, (F.get(u, F.lit(i)) * F.get(v, F.lit(i)) for i in range(k)))
    both = dot("xa", "xa") * dot("xb", "xb")
    algebraic = F.when(both > 0, dot("xa", "xb") * dot("xa", "xb") / both).otherwise(0.0)
    parts = (algebraic, F.coalesce("affinity", F.lit(0.0)), F.least("da", "db") / F.greatest("da", "db"), F.coalesce("near", F.lit(0.0)))
    score = reduce(Column.__add__, (F.lit(w) * part for w, part in zip(LEARNED_WEIGHTS, parts, strict=True)))
    return pool.select("q", "l", "r", score.alias("affinity")).where(F.col("affinity") >= least)


def greedy_match(pairs: pd.DataFrame) -> list[tuple[int, int]]:
    """Pairs in order of falling affinity, then l, then r, each taken if both are free: the rule, for a table that fits a task."""
    taken: set[int] = set()
    out = []
    order = pairs.sort_values(["affinity", "l", "r"], ascending=[False, True, True])
    for left, right in zip(order["l"], order["r"], strict=True):
        if left not in taken and right not in taken:
            taken |= {left, right}
            out.append((int(left), int(right)))
    return out


def greedy_matching(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """(q, l, r): what ``greedy_match`` takes, for tables of any size.

    In a total order, greedy takes exactly the pairs that come first at both their ends, then those that do among pairs
    with free ends, and so on.  A round is one group-by and equi-joins; as many rounds follow as the longest chain of pairs
    that wait for each other, a logarithm for affinities in no particular order.
    """
    first = F.struct("affinity", (-F.col("l")).alias("nl"), (-F.col("r")).alias("nr"))
    rest = scratch.table(candidates.select("q", "l", "r", "affinity"))
    taken = []
    while not rest.isEmpty():
        best = rest.select("q", F.explode(F.array("l", "r")).alias("v"), first.alias("key")).groupBy("q", "v").agg(F.max("key").alias("key"))
        side = lambda end: best.select("q", F.col("v").alias(end), F.col("key").alias(f"_{end}"))  # noqa: B023, E731
        chosen = rest.join(side("l"), ["q", "l"]).join(side("r"), ["q", "r"]).where((F.col("_l") == F.col("_r")) & (F.col("_l") == first))
        taken.append(scratch.table(chosen.select("q", "l", "r")))
        gone = taken[-1].select("q", F.explode(F.array("l", "r")).alias("v"))
        left = rest.join(gone.withColumnRenamed("v", "l"), ["q", "l"], "left_anti").join(gone.withColumnRenamed("v", "r"), ["q", "r"], "left_anti")
        before, rest = rest, scratch.table(left.select("q", "l", "r", "affinity"))
        scratch.drop(before)
    return reduce(DataFrame.unionByName, taken) if taken else candidates.select("q", "l", "r")


def matching_map(candidates: DataFrame, levels: DataFrame, scratch: Scratch) -> DataFrame:
    """(q, l, parent): greedy matching of each factor's levels; aggregates are numbered by their smallest level."""
    merged = greedy_matching(candidates, scratch).select("q", F.col("r").alias("l"), F.col("l").alias("head"))
    heads = scratch.table(levels.select("q", "l").join(merged, ["q", "l"], "left").withColumn("head", F.coalesce("head", "l")))
    places = scratch.table(numbered(heads.select("q", "head").distinct(), ["q", "head"], "place", scratch=scratch))
    starts = places.groupBy("q").agg(F.min("place").alias("start"))  # three rows
    parents = places.join(F.broadcast(starts), "q").select("q", "head", (F.col("place") - F.col("start")).cast("int").alias("parent"))
    return heads.join(parents, ["q", "head"]).select("q", "l", "parent")
