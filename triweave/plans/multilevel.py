"""A V-cycle whose levels are tables, as a preconditioner of ``batch.pcg`` and ``batch.lsmr``."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.model import ModelError
from triweave.operators.columns import Columns, at, each, level_counts, sums
from triweave.operators.encode import CODES
from triweave.operators.linear import degrees, gramian_entries
from triweave.operators.transfer import Hierarchy
from triweave.plans.scratch import Scratch

OMEGA, TERMINAL = 0.5, 256


def terminal_map(tuples: DataFrame, labels: DataFrame, scratch: Scratch, terminal: int = TERMINAL) -> DataFrame | None:
    """(q, l, parent) from tables straight to at most ``terminal`` levels, or None where that would merge what a cycle needs whole.

    Each component's largest factor is cut into aggregates of levels with the same heaviest neighbour or with neighbours in the
    order of these; the other factors keep their levels, so they may be half of ``terminal`` in all.
    """
    sizes = labels.groupBy("component", "q").agg(F.count("*").alias("n")).limit(3 * terminal + 1).collect()
    by: dict[int, dict[int, int]] = {}
    for r in sizes:
        by.setdefault(r.component, {})[r.q] = r.n
    largest = {c: min(n, key=lambda q: (-n[q], q)) for c, n in by.items()}
    large = sum(n[largest[c]] for c, n in by.items())
    whole = sum(sum(n.values()) for n in by.values()) - large
    if len(sizes) > 3 * terminal or 2 * whole > terminal or large + whole <= terminal:
        return None
    share = [(c, q, by[c][q], max(1, (terminal - whole) * by[c][q] // large)) for c, q in largest.items()]
    cut = F.broadcast(labels.sparkSession.createDataFrame(share, "component int, q int, n long, parts long"))
    own = labels.select(F.col("component").cast("int").alias("component"), F.col("q").cast("int").alias("q"), "l").join(cut, ["component", "q"], "left")
    pairs = []
    for q in sorted(set(largest.values())):
        for o in (x for x in range(3) if x != q):
            pairs.append(tuples.groupBy(F.col(CODES[q]).alias("l"), F.col(CODES[o]).alias("r")).agg(F.sum("w").alias("w")).select(F.lit(q).alias("q"), "l", F.struct("w", F.lit(-o).alias("o"), (-F.col("r")).alias("r")).alias("best")))
    best = reduce(DataFrame.unionByName, pairs).groupBy("q", "l").agg(F.max("best").alias("best"))
    merged = own.where("n IS NOT NULL").join(best, ["q", "l"]).select("q", "l", "component", "n", "parts", F.col("best.o").alias("o"), F.col("best.r").alias("r"))
    order = ["component", "q", "o", "r", "l"]
    placed = scratch.table(numbered(merged, order, "place", scratch=scratch))
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    groups = placed.join(F.broadcast(first), "component").select("q", "l", "component", F.floor((F.col("place") - F.col("first")) * F.col("parts") / F.col("n")).alias("head"))
    rows = scratch.table(groups.unionByName(own.where("n IS NULL").select("q", "l", "component", F.col("l").cast("long").alias("head"))))
    heads = rows.select("q", "component", "head").distinct()  # at most ``terminal``
    heads = heads.select("q", "component", "head", (F.row_number().over(W.partitionBy("q").orderBy("component", "head")) - 1).cast("int").alias("parent"))
    return rows.join(F.broadcast(heads), ["q", "component", "head"]).select("q", "l", "parent")


class VCycle:
    """One Jacobi step before and one after the correction from the next level, on every level but the last; there the
    pseudoinverse, in the driver, of at most ``terminal`` levels.  Symmetric, so it may precondition.

    Columns are the elements of arrays; each level costs the jobs of one column.  Close it to drop the layouts' tables.
    ``finest``: the tuples' Columns of the first level, shared with a solver that closes them.
    """

    def __init__(self, hierarchy: Hierarchy, k: int, scratch: Scratch, omega: float = OMEGA, terminal: int = TERMINAL, grouped: bool = True, finest: Columns | None = None):
        if not 0 < omega < 2 / 3:
            raise ModelError("relaxation out of range", str(omega))
        self.maps, self.k, self.scratch, self.omega = hierarchy.maps, k, scratch, omega
        last = hierarchy.levels[-1]
        self.index = [(r.q, r.l) for r in hierarchy.labels[-1].orderBy("q", "l").limit(terminal + 1).collect()]
        if len(self.index) > terminal:
            raise ModelError("terminal too large", f"over {terminal} levels")
        place = {v: i for i, v in enumerate(self.index)}
        g = np.zeros((len(self.index),) * 2)
        for r in gramian_entries(last).collect():  # at most the square of ``terminal``
            g[place[r.q1, r.l1], place[r.q2, r.l2]] = r.g
        self.inverse = np.linalg.pinv(g, rcond=1e-12, hermitian=True)
        shared = [finest] if finest is not None else []
        self.made = [Columns(t, k, scratch, grouped, level_counts(own)) for t, own in list(zip(hierarchy.levels[:-1], hierarchy.labels[:-1], strict=True))[len(shared) :]]
        self.ops = shared + self.made
        self.degrees = [scratch.table(degrees(t)) for t in hierarchy.levels[:-1]]

    def __enter__(self) -> VCycle:
        return self

    def __exit__(self, *_) -> None:
        for op in self.made:
            op.__exit__()

    def __call__(self, r: DataFrame) -> DataFrame:
        """(q, l, x) from a residual (q, l, x)."""
        return self._cycle(0, self.scratch.table(r))

    def _cycle(self, i: int, r: DataFrame) -> DataFrame:
        if i == len(self.ops):
            return self._terminal(r)
        k, op, m = self.k, self.ops[i], self.maps[i]
        relax = each(k, lambda j: F.lit(self.omega) * at("x", j) / F.col("d"))
        first = self.scratch.table(r.join(self.degrees[i], ["q", "l"]).select("q", "l", relax.alias("x")))
        down = self._residual(op, r, first).join(m, ["q", "l"]).groupBy("q", F.col("parent").alias("l")).agg(sums(k, lambda j: at("x", j)).alias("x"))
        coarse = self._cycle(i + 1, self.scratch.table(down))
        lifted = m.join(coarse.select("q", F.col("l").alias("parent"), F.col("x").alias("up")), ["q", "parent"]).select("q", "l", "up")
        second = self.scratch.table(first.join(lifted, ["q", "l"]).select("q", "l", each(k, lambda j: at("x", j) + at("up", j)).alias("x")))
        rest = self._residual(op, r, second).join(self.degrees[i], ["q", "l"]).select("q", "l", relax.alias("more"))
        return self.scratch.table(second.join(rest, ["q", "l"]).select("q", "l", each(k, lambda j: at("x", j) + at("more", j)).alias("x")))

    def _residual(self, op: Columns, r: DataFrame, x: DataFrame) -> DataFrame:
        gx = op.gramian(x).withColumnRenamed("x", "gx")
        return r.join(gx, ["q", "l"]).select("q", "l", each(self.k, lambda j: at("x", j) - at("gx", j)).alias("x"))

    def _terminal(self, r: DataFrame) -> DataFrame:
        have = {(row.q, row.l): row.x for row in r.collect()}  # at most ``terminal`` rows
        x = self.inverse @ np.array([have.get(v, [0.0] * self.k) for v in self.index]).reshape(len(self.index), self.k)
        rows = [(q, level, [float(v) for v in row]) for (q, level), row in zip(self.index, x, strict=True)]
        return r.sparkSession.createDataFrame(rows, "q int, l int, x array<double>")
