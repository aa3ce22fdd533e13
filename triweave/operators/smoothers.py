"""Smoothers on tables: weighted Jacobi, alternating projections over the factors, compatible projection.

Levels of one factor share no tuple, so a factor's block of the Gramian is diagonal and each step of a sweep is one
join and one group-by.  Coefficient tables are (q, l, x); a level of ``tuples`` without a row in them drops out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators.encode import CODES
from triweave.operators.linear import degrees


def jacobi(tuples: DataFrame, r: DataFrame, omega: float = 0.5) -> DataFrame:
    """omega D^-1 r; G is at most 3D, so omega stays below 2/3."""
    if not 0 < omega < 2 / 3:
        raise ModelError("relaxation out of range", str(omega))
    return r.join(degrees(tuples), ["q", "l"]).select("q", "l", (F.lit(omega) * F.col("x") / F.col("d")).alias("x"))


def block_solve(tuples: DataFrame, r: DataFrame, order: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The block-triangular solve that takes the factors in ``order``, each from those before it."""
    own = r.join(degrees(tuples), ["q", "l"])
    parts, seen = [], tuples.withColumn("_z", F.lit(0.0))
    for q in order:
        c = CODES[q]
        rest = seen.groupBy(c).agg(F.sum(F.col("w") * F.col("_z")).alias("_s"))
        z = own.where(F.col("q") == q).select(F.col("l").alias(c), "x", "d").join(rest, c).select(c, ((F.col("x") - F.col("_s")) / F.col("d")).alias("_zq"))
        parts.append(z.select(F.lit(q).alias("q"), F.col(c).alias("l"), F.col("_zq").alias("x")))
        seen = seen.join(z, c).withColumn("_z", F.col("_z") + F.col("_zq")).drop("_zq")
    return reduce(DataFrame.unionByName, parts)


def symmetric_map(tuples: DataFrame, r: DataFrame) -> DataFrame:
    """Forward solve, product with D, backward solve; the caller projects before and after."""
    scaled = block_solve(tuples, r).join(degrees(tuples), ["q", "l"]).select("q", "l", (F.col("x") * F.col("d")).alias("x"))
    return block_solve(tuples, scaled, (2, 1, 0))


def compatible_projection(tuples: DataFrame, x: DataFrame, m: DataFrame) -> DataFrame:
    """x less the degree-weighted mean of its aggregate; the map ``m`` is (q, l, parent)."""
    own = x.join(degrees(tuples), ["q", "l"]).join(m, ["q", "l"])
    means = own.groupBy("q", "parent").agg((F.sum(F.col("d") * F.col("x")) / F.sum("d")).alias("_mean"))
    return own.join(means, ["q", "parent"]).select("q", "l", (F.col("x") - F.col("_mean")).alias("x"))
