"""Components of the incidence hypergraph, their structural kernel and its projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.operators.encode import CODES
from triweave.operators.graph import connected_components
from triweave.plans.scratch import Scratch


def global_index(levels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(q, l, g): factor-major positions."""
    sizes = counts if counts is not None else levels.groupBy("q").agg((F.max("l") + 1).alias("n"))
    offsets = sizes.select("q", F.coalesce(F.sum("n").over(W.orderBy("q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # three rows
    return levels.select("q", "l").join(F.broadcast(offsets), "q").select("q", "l", (F.col("l") + F.col("offset")).cast("long").alias("g"))


def component_labels(tuples: DataFrame, scratch: Scratch) -> DataFrame:
    """(q, l, component): labels number the components by their smallest factor-major position.

    The graph is contracted to the factor with the fewest levels: every other level hangs on the least of them among its
    tuples, and that one is linked with the rest.  So tuples move for two joins at most, and the rounds are on few levels.
    """
    counts = tuples.agg(*(F.approx_count_distinct(c).alias(c) for c in CODES)).first()
    hub = min(CODES, key=lambda c: counts[c])
    others = [c for c in CODES if c != hub]
    least = {c: scratch.table(tuples.groupBy(c).agg(F.min(hub).alias("u"))) for c in others}
    links = [tuples.select(c, F.col(hub).alias("v")).join(least[c], c).where("u <> v").select("u", "v").distinct() for c in others]
    found = scratch.table(connected_components(links[0].unionByName(links[1]), scratch))
    hubs = least[others[0]].select("u").union(least[others[1]].select("u")).distinct()  # hubs without a link are their own
    roots = scratch.table(found.unionByName(hubs.join(found, hubs["u"] == found["node"], "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))))
    level = lambda c, rows, at: rows.join(roots.withColumnRenamed("node", at), at).select(F.lit(CODES.index(c)).alias("q"), F.col(c).alias("l"), F.col("component").alias("root"))
    levels = level(hub, roots.select(F.col("node").alias(hub), F.col("node").alias("u")), "u")
    for c in others:
        levels = levels.unionByName(level(c, least[c], "u"))
    levels = scratch.table(levels.repartition("q", "l"))
    # the positions of the first factor come first, and every component has levels of it
    first = levels.where("q = 0").groupBy("root").agg(F.min("l").alias("first"))
    names = numbered(first, ["first"], "label").select("root", F.col("label").cast("int").alias("component"))
    return levels.join(names, "root").select("q", "l", "component")


def component_sizes(labels: DataFrame) -> DataFrame:
    """(component, n0, n1, n2)."""
    return labels.groupBy("component").agg(*(F.sum((F.col("q") == q).cast("long")).alias(f"n{q}") for q in range(3)))


def project_structural(x: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, l, x): x without its part in each component's span of (1, -1, 0) and (1, 0, -1).

    With sums s and sizes n of the three factors, the shifts solve
    (n0 + n1) p + n0 r = s0 - s1 and n0 p + (n0 + n2) r = s0 - s2; p + r, -p and -r are taken away.
    """
    own = x.join(labels, ["q", "l"])
    sums = own.groupBy("component").agg(
        *(F.sum(F.when(F.col("q") == q, F.col("x")).otherwise(0.0)).alias(f"s{q}") for q in range(3)),
        *(F.sum((F.col("q") == q).cast("double")).alias(f"n{q}") for q in range(3)),
    )
    det = (F.col("n0") + F.col("n1")) * (F.col("n0") + F.col("n2")) - F.col("n0") * F.col("n0")
    r1, r2 = F.col("s0") - F.col("s1"), F.col("s0") - F.col("s2")
    p = (r1 * (F.col("n0") + F.col("n2")) - F.col("n0") * r2) / det
    r = ((F.col("n0") + F.col("n1")) * r2 - F.col("n0") * r1) / det
    shifts = sums.select("component", p.alias("p"), r.alias("r"))
    shift = F.when(F.col("q") == 0, F.col("p") + F.col("r")).when(F.col("q") == 1, -F.col("p")).otherwise(-F.col("r"))
    return own.join(shifts, "component").select("q", "l", (F.col("x") - shift).alias("x"))


def structural_defect(x: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, defect): the larger of the differences of factor sums."""
    s = [F.sum(F.when(F.col("q") == q, F.col("x")).otherwise(0.0)) for q in range(3)]
    return x.join(labels, ["q", "l"]).groupBy("component").agg(F.greatest(F.abs(s[0] - s[1]), F.abs(s[0] - s[2])).alias("defect"))


def local_codes(labels: DataFrame) -> DataFrame:
    """(q, l, component, local): a level's number within its component and factor."""
    place = F.row_number().over(W.partitionBy("component", "q").orderBy("l")) - 1
    return labels.withColumn("local", place.cast("int"))


class ComponentLayout:
    """A permutation that puts the levels of each component side by side: positions (q, l, component, position), in order
    of component, factor and level, as a table in the shared folder."""

    def __init__(self, labels: DataFrame, scratch: Scratch):
        self.positions = scratch.table(numbered(labels.select("component", "q", "l"), ["component", "q", "l"], "position", scratch=scratch).select("q", "l", "component", "position"))

    def gather(self, x: DataFrame) -> DataFrame:
        """(position, component, x) of (q, l, x)."""
        return x.join(self.positions, ["q", "l"]).select("position", "component", "x")

    def scatter(self, values: DataFrame) -> DataFrame:
        """(q, l, x) of (position, x)."""
        return values.join(self.positions.select("q", "l", "position"), "position").select("q", "l", "x")

    def ranges(self) -> DataFrame:
        """(component, start, n): where each component lies."""
        return self.positions.groupBy("component").agg(F.min("position").alias("start"), F.count("*").alias("n"))
