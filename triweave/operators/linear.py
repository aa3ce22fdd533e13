"""The incidence matrix B as joins and group-bys.

``tuples``: (tid, a, b, c, w).  Coefficient tables: (q, l, x) with q in 0..2.  A coefficient side is
joined once for each factor; Spark broadcasts it when its size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.operators.encode import CODES
from triweave.operators.exact import exact_sums
from triweave.plans.scratch import Scratch


def factor_side(x: DataFrame, q: int, value: str = "x") -> DataFrame:
    return x.where(F.col("q") == q).select(F.col("l").alias(CODES[q]), F.col(value).alias(f"_{value}{q}"))


def incidence(tuples: DataFrame, x: DataFrame, value: str = "x", name: str = "bx", how: str = "inner") -> DataFrame:
    """Bx: ``tuples`` with x0[a] + x1[b] + x2[c]; with ``how`` left, null where a level has no coefficient."""
    joined = reduce(lambda t, q: t.join(factor_side(x, q, value), CODES[q], how), range(3), tuples)
    return joined.withColumn(name, reduce(lambda p, q: p + F.col(f"_{value}{q}"), (1, 2), F.col(f"_{value}0"))).drop(*(f"_{value}{q}" for q in range(3)))


def edges(tuples: DataFrame, *values: Column | str) -> DataFrame:
    """Three rows (q, l, values) for each tuple."""
    return tuples.select(F.posexplode(F.array(*CODES)).alias("q", "l"), *values)


def adjoint(tuples: DataFrame, value: Column, name: str = "x") -> DataFrame:
    """B'v: (q, l, name)."""
    return edges(tuples, value.alias("_v")).groupBy("q", "l").agg(F.sum("_v").alias(name))


def weighted_incidence(tuples: DataFrame, x: DataFrame) -> DataFrame:
    """sqrt(W) B x."""
    out = incidence(tuples, x)
    return out.withColumn("bx", F.sqrt("w") * F.col("bx"))


def weighted_adjoint(tuples: DataFrame, value: Column, exact: str | None = None) -> DataFrame:
    """B' sqrt(W) v; with a decimal type ``exact``, products are rounded to it and summed without an order."""
    v = F.sqrt("w") * value
    return adjoint(tuples, v.cast(exact) if exact else v)


def gramian(tuples: DataFrame, x: DataFrame, name: str = "gx") -> DataFrame:
    """B'WB x with one shuffle of partial sums."""
    return adjoint(incidence(tuples, x), F.col("w") * F.col("bx"), name)


def gramian_with_image(tuples: DataFrame, x: DataFrame, scratch: Scratch, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(image, gx): the tuple image WBx, written once as (tid, a, b, c, image), and B' of it; ``keep``: it outlives the run."""
    image = (scratch.keep if keep else scratch.table)(incidence(tuples, x).select("tid", *CODES, (F.col("w") * F.col("bx")).alias("image")))
    return image, adjoint(image, F.col("image"), "gx")


def energy(tuples: DataFrame, x: DataFrame) -> DataFrame:
    """x'Gx, one row."""
    return incidence(tuples, x).agg(F.sum(F.col("w") * F.col("bx") * F.col("bx")).alias("energy"))


def exact_energy(tuples: DataFrame, x: DataFrame) -> DataFrame:
    """x'Gx, one row: the tuples' terms summed exactly and rounded once."""
    return exact_sums(incidence(tuples, x), [], {"energy": F.col("w") * F.col("bx") * F.col("bx")}).select("energy")


def rhs(tuples: DataFrame, target: str = "y") -> DataFrame:
    """B'Wy."""
    return adjoint(tuples, F.col("w") * F.col(target), "rhs")


def rhs_from_sums(tuples: DataFrame, weighted: str = "wy") -> DataFrame:
    """B'Wy from weighted sums kept with the tuples."""
    return adjoint(tuples, F.col(weighted), "rhs")


def component_rhs(tuples: DataFrame, labels: DataFrame, component: int, target: str = "y") -> DataFrame:
    """B'Wy of one component's tuples; a tuple lies in the component of its first level."""
    own = labels.where((F.col("q") == 0) & (F.col("component") == component)).select(F.col("l").alias("a"))
    return rhs(tuples.join(own, "a", "left_semi"), target)


def residual(tuples: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - Gx; missing entries count as 0."""
    return b.join(gramian(tuples, x), ["q", "l"], "full_outer").select("q", "l", (F.coalesce("rhs", F.lit(0)) - F.coalesce("gx", F.lit(0))).alias("r"))


def degrees(tuples: DataFrame, name: str = "d") -> DataFrame:
    """Weighted degrees, the diagonal of the Gramian."""
    return adjoint(tuples, F.col("w"), name)


def gramian_entries(tuples: DataFrame) -> DataFrame:
    """All nonzero entries (q1, l1, q2, l2, g): nine for each tuple, summed."""
    cells = F.array(*(F.struct(F.lit(p).alias("q1"), F.col(CODES[p]).alias("l1"), F.lit(q).alias("q2"), F.col(CODES[q]).alias("l2")) for p in range(3) for q in range(3)))
    return tuples.select(F.explode(cells).alias("e"), "w").groupBy("e.q1", "e.l1", "e.q2", "e.l2").agg(F.sum("w").alias("g"))


def normal_equation_certificate(tuples: DataFrame, x: DataFrame, target: str = "y") -> DataFrame:
    """One row (residual_norm, rhs_norm, ratio): |B'W(y - Bx)| / |B'Wy|; 0/0 is 0, nonzero/0 is null, and so
    is the ratio where a tuple lacks a coefficient."""
    fitted = incidence(tuples, x, how="left")
    parts = edges(fitted, (F.col("w") * (F.col(target) - F.col("bx"))).alias("r"), (F.col("w") * F.col(target)).alias("b")).groupBy("q", "l").agg(F.sum("r").alias("r"), F.sum("b").alias("b"), F.max(F.col("r").isNull()).alias("lacks"))
    norms = parts.agg(F.max("lacks").alias("lacks"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("residual_norm"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("rhs_norm"))
    ratio = F.when(F.col("lacks"), F.lit(None)).when(F.col("rhs_norm") > 0, F.col("residual_norm") / F.col("rhs_norm")).when(F.col("residual_norm") == 0, F.lit(0.0))
    return norms.select("residual_norm", "rhs_norm", ratio.cast("double").alias("ratio"))


def extrema_by_component(tuples: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, min_w, max_w, min_d, max_d) from labels (q, l, component)."""
    own = tuples.join(labels.where("q = 0").select(F.col("l").alias("a"), "component"), "a")
    weights = own.groupBy("component").agg(F.min("w").alias("min_w"), F.max("w").alias("max_w"))
    d = degrees(tuples).join(labels, ["q", "l"]).groupBy("component").agg(F.min("d").alias("min_d"), F.max("d").alias("max_d"))
    return weights.join(d, "component")
