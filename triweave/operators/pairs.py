"""Pair marginals and their bipartite graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.operators.encode import CODES
from triweave.operators.exact import exact_sums, refuse_overflow
from triweave.operators.graph import connected_components
from triweave.plans.scratch import Scratch

PAIRS = (("12", 0, 1), ("13", 0, 2), ("23", 1, 2))


def pair_marginals(tuples: DataFrame) -> DataFrame:
    """(pair, u, v, w): the weights summed over the third factor, all three pairs from one expansion; rows may repeat a tuple."""
    cells = F.array(*(F.struct(F.lit(n).alias("pair"), F.col(CODES[i]).alias("u"), F.col(CODES[j]).alias("v")) for n, (_, i, j) in enumerate(PAIRS)))
    sums = tuples.select(F.explode(cells).alias("e"), "w").groupBy("e.pair", "e.u", "e.v").agg(F.sum("w").alias("w"))
    return sums.withColumn("pair", F.get(F.array(*(F.lit(p) for p, _, _ in PAIRS)), F.col("pair")))  # names only after the shuffle


def pair_degrees(marginals: DataFrame) -> DataFrame:
    """(pair, side, l, d), from the conductances themselves."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("l")), F.struct(F.lit(1).alias("side"), F.col("v").alias("l")))
    return marginals.select("pair", F.explode(ends).alias("e"), "w").groupBy("pair", "e.side", "e.l").agg(F.sum("w").alias("d"))


def pair_laplacian(marginals: DataFrame) -> DataFrame:
    """(pair, i_side, i, j_side, j, value): the Laplacian that the pair's Gramian becomes when its second block's sign is switched."""
    off = marginals.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("u").alias("i"), F.lit(1).alias("t"), F.col("v").alias("j")), F.struct(F.lit(1).alias("s"), F.col("v").alias("i"), F.lit(0).alias("t"), F.col("u").alias("j")))).alias("e"), (-F.col("w")).alias("value"))
    off = off.select("pair", F.col("e.s").alias("i_side"), F.col("e.i").alias("i"), F.col("e.t").alias("j_side"), F.col("e.j").alias("j"), "value")
    diagonal = pair_degrees(marginals).select("pair", F.col("side").alias("i_side"), F.col("l").alias("i"), F.col("side").alias("j_side"), F.col("l").alias("j"), F.col("d").alias("value"))
    return off.unionByName(diagonal)


def pair_components(marginals: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair, side, l, component): the smallest vertex of each pair's component, as pair:side:number."""
    name = lambda side, col: F.concat_ws(":", "pair", F.lit(side), F.lpad(F.col(col).cast("string"), 12, "0"))
    found = connected_components(marginals.select(name("0", "u").alias("x"), name("1", "v").alias("y")), scratch)
    part = F.split("node", ":")
    return found.select(part[0].alias("pair"), part[1].cast("int").alias("side"), part[2].cast("int").alias("l"), "component")


class PairPlan:
    """The edges of the three pair graphs and which edge each tuple adds to, without weights: made once for a topology.

    edges (edge, pair, u, v), numbered in order of pair, u, v; plan (tid, edge), three rows a tuple.  Both are tables in the
    shared folder, so another generation of weights costs a join by tid and a sum by edge number.
    """

    def __init__(self, tuples: DataFrame, scratch: Scratch):
        cells = F.array(*(F.struct(F.lit(p).alias("pair"), F.col(CODES[i]).alias("u"), F.col(CODES[j]).alias("v")) for p, i, j in PAIRS))
        rows = scratch.table(tuples.select("tid", F.explode(cells).alias("e")).select("tid", "e.*"))
        key = ["pair", "u", "v"]
        self.edges = scratch.table(numbered(rows.select(key).distinct(), key, "edge", scratch=scratch).select("edge", *key))
        self.plan = scratch.table(rows.join(self.edges, key).select("tid", "edge"))
        self.scratch = scratch

    def conductances(self, weights: DataFrame) -> DataFrame:
        """(edge, pair, u, v, w) for weights (tid, w): exact sums, rounded once; a sum beyond the doubles is an error."""
        rows = self.plan.join(weights.select("tid", "w"), "tid")
        sums = self.scratch.table(exact_sums(rows, ["edge"], {"w": F.col("w")}).select("edge", "w"))
        return self.edges.join(refuse_overflow(sums, ["w"], "pair conductance"), "edge")

    def degrees(self, conductances: DataFrame) -> DataFrame:
        """(pair, side, l, d): exact sums of the conductances as they stand, not of the tuples' weights."""
        ends = F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("l")), F.struct(F.lit(1).alias("side"), F.col("v").alias("l")))
        rows = conductances.select("pair", F.explode(ends).alias("e"), "w").select("pair", "e.side", "e.l", "w")
        sums = self.scratch.table(exact_sums(rows, ["pair", "side", "l"], {"d": F.col("w")}).select("pair", "side", "l", "d"))
        return refuse_overflow(sums, ["d"], "pair weighted degree")
