"""Up to 32 columns at once: coefficient tables (q, l, x array) and tuple tables with array values.

A column is an element of the arrays; sums run element by element beside each other, so neither rows nor jobs grow
with their number.  ``Columns`` may hold the tuples three times, bucketed and sorted by one factor each (row grouping):
where the levels are few enough to go along by broadcast, a product with the Gramian or a sweep over the factors then
moves no tuple.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.operators.blocks import Blocks
from triweave.operators.encode import CODES
from triweave.plans.scratch import Scratch

#: Coefficients of one factor up to so many bytes go by broadcast.
BROADCAST_BYTES = 32 << 20


def each(k: int, f: Callable[[int], Column]) -> Column:
    """An array of ``k`` elements."""
    return F.array(*(f(i) for i in range(k)))


def sums(k: int, f: Callable[[int], Column]) -> Column:
    """An array of ``k`` sums."""
    return F.array(*(F.sum(f(i)) for i in range(k)))


def at(name: str, i: int) -> Column:
    return F.get(F.col(name), F.lit(i))


def level_counts(levels: DataFrame) -> tuple[int, int, int]:
    """How many levels each factor has in a table with one row a level."""
    found = {r["q"]: r["n"] for r in levels.groupBy("q").agg(F.count("*").alias("n")).collect()}  # three rows
    return found.get(0, 0), found.get(1, 0), found.get(2, 0)


class Columns:
    """The incidence of ``tuples`` (tid, a, b, c, w, ...) for ``k`` columns; ``grouped``: lay the tuples out by factor.

    ``counts``: the numbers of levels, counted if not given.  ``labels``: with them, where a factor is too large for a broadcast,
    ``grouped`` packs the tuples in blocks for products with the Gramian.  Close it to drop the layouts' tables.
    """

    def __init__(self, tuples: DataFrame, k: int, scratch: Scratch, grouped: bool = False, counts: tuple[int, int, int] | None = None, labels: DataFrame | None = None):
        self.tuples, self.k, self.scratch, self.names = tuples, k, scratch, []
        if counts is None:
            counts = level_counts(tuples.select(F.posexplode(F.array(*CODES)).alias("q", "l")).distinct())
        self.counts = counts
        self.small = [n * (8 * k + 16) <= BROADCAST_BYTES for n in counts]
        self.by: list[DataFrame] | None = None
        if grouped and all(self.small):
            self.by = [self._layout(c) for c in CODES]
        self.blocks = Blocks(tuples, labels, k, scratch, counts) if grouped and self.by is None and labels is not None else None

    def _layout(self, code: str) -> DataFrame:
        spark, name = self.tuples.sparkSession, f"tuples_by_{code}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.tuples.select("tid", *CODES, "w").repartition(buckets, code)
        rows.write.bucketBy(buckets, code).sortBy(code).option("path", f"{self.scratch.root}/scratch/{name}").saveAsTable(name)
        self.names.append(name)
        return spark.table(name)

    def __enter__(self) -> Columns:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.tuples.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        if self.blocks is not None:
            self.blocks.close()

    def side(self, x: DataFrame, q: int) -> DataFrame:
        own = x.where(F.col("q") == q).select(F.col("l").alias(CODES[q]), F.col("x").alias(f"_x{q}"))
        return F.broadcast(own) if self.small[q] else own

    def image(self, x: DataFrame, tuples: DataFrame | None = None, factors: tuple[int, ...] = (0, 1, 2), name: str = "bx", how: str = "inner") -> DataFrame:
        """``tuples`` with the sums of the factors' coefficients as an array."""
        rows = self.tuples if tuples is None else tuples
        for q in factors:  # one running sum, as joins may move the rows
            total = F.col(f"_x{q}") if q == factors[0] else each(self.k, lambda i, q=q: at(name, i) + at(f"_x{q}", i))
            rows = rows.join(self.side(x, q), CODES[q], how).withColumn(name, total).drop(f"_x{q}")
        return rows

    def adjoint(self, tuples: DataFrame, value: Callable[[int], Column]) -> DataFrame:
        """B'v for an array of tuple values: one shuffle of partial sums."""
        rows = tuples.select(F.posexplode(F.array(*CODES)).alias("q", "l"), each(self.k, value).alias("_v"))
        return rows.groupBy("q", "l").agg(sums(self.k, lambda i: at("_v", i)).alias("x"))

    def gramian(self, x: DataFrame) -> DataFrame:
        """B'WB x as (q, l, x)."""
        weighted = lambda i: F.col("w") * at("bx", i)
        if self.blocks is not None:
            return self.blocks.gramian(x)
        if self.by is None:
            return self.adjoint(self.image(x), weighted)
        parts = [self.image(x, t).groupBy(c).agg(sums(self.k, weighted).alias("x")).select(F.lit(q).alias("q"), F.col(c).alias("l"), "x") for q, (c, t) in enumerate(zip(CODES, self.by, strict=True))]
        return reduce(DataFrame.unionByName, parts)

    def from_others(self, x: DataFrame, q: int, factors: tuple[int, ...]) -> DataFrame:
        """(code of factor q, _s): for each of its levels the weighted sums of other factors' coefficients."""
        rows = self.image(x, None if self.by is None else self.by[q], factors, "_z")
        return rows.groupBy(CODES[q]).agg(sums(self.k, lambda i: F.col("w") * at("_z", i)).alias("_s"))

    def symmetric_map(self, r: DataFrame, d: DataFrame) -> DataFrame:
        """The symmetric sweep over the factors: forward solve, product with D, backward solve; ``d`` is (q, l, d)."""
        k, own = self.k, r.join(d, ["q", "l"])

        def step(q: int, start: Column, factors: tuple[int, ...], z: DataFrame, base: DataFrame) -> DataFrame:
            mine = base.where(F.col("q") == q).join(self.from_others(z, q, factors).withColumnRenamed(CODES[q], "l"), "l")
            return mine.select("q", "l", each(k, lambda i: F.get(start, F.lit(i)) - at("_s", i) / F.col("d")).alias("x"))

        scaled = own.select("q", "l", "d", each(k, lambda i: at("x", i) / F.col("d")).alias("x"))
        z = self.scratch.table(scaled.where("q = 0").select("q", "l", "x"))
        z = self.scratch.table(z.unionByName(step(1, F.col("x"), (0,), z, scaled)))
        z = self.scratch.table(z.unionByName(step(2, F.col("x"), (0, 1), z, scaled)))
        back = z.join(d, ["q", "l"])
        y = z.where("q = 2")
        y = self.scratch.table(y.unionByName(step(1, F.col("x"), (2,), y, back)))
        return y.unionByName(step(0, F.col("x"), (1, 2), y, back))

    def project(self, x: DataFrame, labels: DataFrame) -> DataFrame:
        """(q, l, x) without the part in each component's structural kernel; as ``components.project_structural``, column by column."""
        own = x.join(labels, ["q", "l"])
        by_factor = own.groupBy("component", "q").agg(sums(self.k, lambda i: at("x", i)).alias("s"), F.count("*").cast("double").alias("n"))
        of = lambda c, q: F.max(F.when(F.col("q") == q, F.col(c))).alias(f"{c}{q}")
        total = by_factor.groupBy("component").agg(*(of(c, q) for c in "sn" for q in range(3)))
        n0, n1, n2 = (F.col(f"n{q}") for q in range(3))
        det = (n0 + n1) * (n0 + n2) - n0 * n0
        # a few rows a component, so lambdas, whose code does not grow with the columns
        less = lambda u, v: F.zip_with(u, v, lambda x, y: x - y)
        total = total.select("component", "n0", "n1", "n2", less("s0", "s1").alias("f"), less("s0", "s2").alias("g"))
        p = F.zip_with("f", "g", lambda f, g: (f * (n0 + n2) - n0 * g) / det)
        r = F.zip_with("f", "g", lambda f, g: ((n0 + n1) * g - n0 * f) / det)
        shifts = total.select("component", p.alias("p"), r.alias("r"))
        minus = lambda c: F.transform(c, lambda v: -v)
        shifts = shifts.select("component", F.array(F.zip_with("p", "r", lambda u, v: u + v), minus("p"), minus("r")).alias("shift"))
        return own.join(shifts, "component").select("q", "l", less(F.col("x"), F.get("shift", F.col("q").cast("int"))).alias("x"))
