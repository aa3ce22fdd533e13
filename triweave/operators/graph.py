"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014).

Every step is a group-by and an equi-join, so a node with very many edges is summed before the shuffle
and its join can be split; each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    ``edges``: two columns of one orderable type; direction, repetition, loops and nulls don't matter.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    now = scratch.table(now)
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = scratch.table(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        after = scratch.table(small.where("v <> u").distinct())
        for old in (now, large):
            scratch.drop(old)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("v", "u")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
