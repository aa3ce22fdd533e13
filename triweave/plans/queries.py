"""Named queries of the engine's operators over the star schema, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions.ranks import ONE_TASK_ROWS
from triweave.model import Design, Topology
from triweave.operators import candidates as cand
from triweave.operators import components as comp
from triweave.operators import encode as enc
from triweave.operators import kernel, linear, pairs, smoothers, transfer
from triweave.plans import solve
from triweave.plans.scratch import Scratch
from triweave.sources.designs import observations, row_bound, sql_prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DESIGN = Design(("k1", "k2", "k3"))


@dataclass
class Loaded:
    """A design on its tables: coded observations and canonical tuples (tid, a, b, c, w, w2, n_obs, wy)."""

    spark: SparkSession
    obs: DataFrame
    bound: int

    @cached_property
    def rows(self) -> DataFrame:
        """The observations, written once where there may be many."""
        return enc.written(self.obs, self.bound)

    @cached_property
    def codes(self) -> list[DataFrame]:
        return enc.level_codes(self.rows, DESIGN.factors, self.bound)

    @property
    def coded(self) -> DataFrame:
        return enc.with_codes(self.rows, DESIGN, self.codes)

    @property
    def collapsed(self) -> DataFrame:
        """Tuples with those sums that the observations' columns allow."""
        return self._collapse(self.coded)

    def _collapse(self, coded: DataFrame) -> DataFrame:
        have = self.obs.columns
        sums = {"w2": F.sum("w2")} if "w2" in have else {}
        if "y" in have:
            sums |= {"wy": F.sum(F.col("y").cast("decimal(18,2)") * F.col("w").cast("decimal(9,0)")), "y": F.max("y")}
        made = enc.collapse(coded, "w", sums)
        return made if "row_id" in have else made.drop("n_obs")

    @property
    def tuples(self) -> DataFrame:
        return self._numbered(lambda t: t)

    def _numbered(self, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Canonical tuples with the columns that ``made`` takes from the sums, as many are written where they are numbered."""
        if self.bound > ONE_TASK_ROWS and enc.mostly_distinct(self.rows, DESIGN.factors):
            dealt = enc.dealt_by_tuple(self.coded.drop(*DESIGN.factors), self.bound)
            return enc.canonical_tuples(made(self._collapse(dealt)), self.bound, dealt=True)
        return enc.canonical_tuples(made(self.collapsed), self.bound)

    def means(self, scratch: Scratch) -> DataFrame:
        """A table of the tuples (tid, a, b, c, w, y) with the weighted mean of their observations as target."""
        t = self._numbered(lambda t: t.select(*enc.CODES, "w", (F.col("wy").cast("double") / F.col("w")).alias("y"))).select("tid", *enc.CODES, "w", "y")
        return scratch.given(t) if self.bound > ONE_TASK_ROWS else scratch.table(t)

    def levels(self, tuples: DataFrame) -> DataFrame:
        """(q, l) of the canonical tuples: where there may be many, as the dictionaries have them."""
        if self.bound <= ONE_TASK_ROWS:
            return linear.edges(tuples).distinct()
        return reduce(DataFrame.unionByName, (t.select(F.lit(q).alias("q"), F.col(c).alias("l")) for q, (c, t) in enumerate(zip(enc.CODES, self.codes, strict=True))))

    def x(self, tuples: DataFrame) -> DataFrame:
        """Integer coefficients l % 7 - 3."""
        return self.levels(tuples).withColumn("x", (F.col("l") % 7 - 3).cast("double"))


def query(name: str, design: str, sql: str | None = None, needs: tuple[str, ...] | None = None):
    """Registers f(Loaded) -> DataFrame; ``sql`` follows the design's common table expressions.  ``needs``: the only columns
    of the observations, beside the factors, that f reads, as many rows are written and moved with all that they have."""

    def wrap(f: Callable[[Loaded], DataFrame]) -> Callable[[Loaded], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            obs = observations(spark, sf_dir, design)
            return f(Loaded(spark, obs if needs is None else obs.select(*DESIGN.factors, *needs), row_bound(spark, sf_dir, design)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql_prelude(design) + " " + sql
        return f

    return wrap


# --- encoding ---------------------------------------------------------------------------------------------


@query("collapse_tuples", "D1", "SELECT a, b, c, w, CAST(n_obs AS BIGINT) AS n_obs FROM t")
def collapse_tuples(d: Loaded) -> DataFrame:
    return d.collapsed.select("a", "b", "c", "w", "n_obs")


@query("canonical_tuples", "D2", "SELECT CAST(tid AS BIGINT) AS tid, a, b, c, w FROM t")
def canonical_tuples(d: Loaded) -> DataFrame:
    return d.tuples.select("tid", "a", "b", "c", "w")


@query("level_codes", "D2", "SELECT 0 AS q, a AS l, CAST(k1 AS VARCHAR) AS key FROM v1 UNION ALL SELECT 1, b, k2 FROM v2 UNION ALL SELECT 2, c, CAST(k3 AS VARCHAR) FROM v3")
def level_codes(d: Loaded) -> DataFrame:
    return enc.encode(d.obs, DESIGN, d.bound).levels


@query("observation_to_tuple", "D1", "SELECT row_id, CAST(tid AS BIGINT) AS tid FROM coded JOIN t USING (a, b, c)", ("row_id",))
def observation_to_tuple(d: Loaded) -> DataFrame:
    return enc.encode(d.obs, DESIGN, d.bound).obs_map


@query("tuple_group_offsets", "D2", "SELECT CAST(tid AS BIGINT) AS tid, CAST(n_obs AS BIGINT) AS n, CAST(SUM(n_obs) OVER (ORDER BY tid) - n_obs AS BIGINT) AS start FROM t")
def tuple_group_offsets(d: Loaded) -> DataFrame:
    return enc.group_offsets(enc.encode(d.obs, DESIGN, d.bound).obs_map)


@query("scatter_to_observations", "D2", "SELECT row_id, t.w AS w FROM coded JOIN t USING (a, b, c)")
def scatter_to_observations(d: Loaded) -> DataFrame:
    topology = enc.encode(d.obs, DESIGN, d.bound)
    frame = enc.weight_frame(topology, "observations", "w")
    return enc.scatter_to_observations(topology, frame.weights.select("tid", "w"))


def _frame(d: Loaded, kind: str, weight: str = "w") -> DataFrame:
    topology: Topology = enc.encode(d.obs, DESIGN, d.bound)
    values = weight if kind == "observations" else None
    if kind == "tuples":
        values = topology.tuples.select("tid", (F.col("tid") % 5 + 1).cast("double").alias("w"))
    return enc.weight_frame(topology, kind, values).weights.select("tid", "a", "b", "c", "w")


for _kind, _w in (("observations", "w"), ("tuples", "CAST(tid % 5 + 1 AS DOUBLE)"), ("unit_observations", "CAST(n_obs AS DOUBLE)"), ("unit_tuples", "CAST(1 AS DOUBLE)")):
    query(f"weight_frame_{_kind}", "D2", f"SELECT CAST(tid AS BIGINT) AS tid, a, b, c, {_w} AS w FROM t")(lambda d, kind=_kind: _frame(d, kind))
query("reweight_second_generation", "D2", "SELECT CAST(tid AS BIGINT) AS tid, a, b, c, w2 AS w FROM t")(lambda d: _frame(d, "observations", "w2"))

# --- linear actions ---------------------------------------------------------------------------------------


@query("incidence_apply", "D1", "SELECT CAST(tid AS BIGINT) AS tid, bx FROM bx", ("w",))
def incidence_apply(d: Loaded) -> DataFrame:
    t = d.tuples
    return linear.incidence(t, d.x(t)).select("tid", "bx")


@query("adjoint_apply", "D1", "SELECT q, l, CAST(SUM(tid % 11 - 5) AS DOUBLE) AS x FROM e GROUP BY q, l", ("w",))
def adjoint_apply(d: Loaded) -> DataFrame:
    return linear.adjoint(d.tuples, (F.col("tid") % 11 - 5).cast("double"))


@query("weighted_incidence", "D1", "SELECT CAST(tid AS BIGINT) AS tid, round(sqrt(w) * bx, 6) AS bx FROM bx", ("w",))
def weighted_incidence(d: Loaded) -> DataFrame:
    t = d.tuples
    return linear.weighted_incidence(t, d.x(t)).select("tid", F.round("bx", 6).alias("bx"))


@query("weighted_adjoint", "D1", "SELECT q, l, round(SUM(CAST(sqrt(w) * (tid % 11 - 5) AS DECIMAL(28, 12)))::DOUBLE, 5) AS x FROM e GROUP BY q, l", ("w",))
def weighted_adjoint(d: Loaded) -> DataFrame:
    out = linear.weighted_adjoint(d.tuples, F.col("tid") % 11 - 5, "decimal(28,12)")
    return out.withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("gramian_apply", "D1", "SELECT q, l, SUM(e.w * bx) AS gx FROM e JOIN (SELECT tid, bx FROM bx) USING (tid) GROUP BY q, l", ("w",))
def gramian_apply(d: Loaded) -> DataFrame:
    t = d.tuples
    return linear.gramian(t, d.x(t))


@query("gramian_image", "D1", "SELECT CAST(tid AS BIGINT) AS tid, w * bx AS image FROM bx", ("w",))
def gramian_image(d: Loaded) -> DataFrame:
    t = d.tuples
    with Scratch(d.spark, "image") as s:
        return linear.gramian_with_image(t, d.x(t), s, keep=True)[0].select("tid", "image")


@query("energy", "D1", "SELECT SUM(w * bx * bx) AS energy FROM bx", ("w",))
def energy(d: Loaded) -> DataFrame:
    t = d.tuples
    return linear.energy(t, d.x(t))


@query("rhs_from_targets", "D1", "SELECT q, l, CAST(SUM(wy) AS DOUBLE) AS rhs FROM e GROUP BY q, l", ("w", "y"))
def rhs_from_targets(d: Loaded) -> DataFrame:
    return linear.rhs_from_sums(d.tuples).withColumn("rhs", F.col("rhs").cast("double"))


@query("residual", "D1", "SELECT q, l, SUM(e.w * (e.tid % 11 - 5)) - SUM(e.w * bx) AS r FROM e JOIN (SELECT tid, bx FROM bx) USING (tid) GROUP BY q, l", ("w",))
def residual(d: Loaded) -> DataFrame:
    t = d.tuples.withColumn("y", (F.col("tid") % 11 - 5).cast("double"))
    return linear.residual(t, d.x(t), linear.rhs(t))


@query(
    "dense_gramian_entries",
    "D2",
    """SELECT q1, l1, q2, l2, SUM(w) AS g FROM (SELECT x.q AS q1, x.l AS l1, y.q AS q2, y.l AS l2, x.w FROM e x JOIN e y USING (tid)) GROUP BY ALL""",
)
def dense_gramian_entries(d: Loaded) -> DataFrame:
    return linear.gramian_entries(d.tuples)


@query("weighted_degrees", "D1", "SELECT q, l, SUM(w) AS d FROM e GROUP BY q, l", ("w",))
def weighted_degrees(d: Loaded) -> DataFrame:
    return linear.degrees(d.tuples)


@query(
    "normal_equation_certificate",
    "D1",
    """, s AS (SELECT q, l, SUM(e.w * (e.tid % 11 - 5 - bx)) AS r, SUM(e.w * (e.tid % 11 - 5)) AS b FROM e JOIN (SELECT tid, bx FROM bx) USING (tid) GROUP BY q, l)
    SELECT round(sqrt(SUM(r * r)), 6) AS residual_norm, round(sqrt(SUM(b * b)), 6) AS rhs_norm, round(sqrt(SUM(r * r)) / sqrt(SUM(b * b)), 9) AS ratio FROM s""",
    ("w",),
)
def normal_equation_certificate(d: Loaded) -> DataFrame:
    t = d.tuples.withColumn("y", (F.col("tid") % 11 - 5).cast("double"))
    out = linear.normal_equation_certificate(t, d.x(t))
    return out.select(F.round("residual_norm", 6).alias("residual_norm"), F.round("rhs_norm", 6).alias("rhs_norm"), F.round("ratio", 9).alias("ratio"))


# --- components -------------------------------------------------------------------------------------------


def _labelled(d: Loaded, f: Callable[[DataFrame, DataFrame, Scratch], DataFrame]) -> DataFrame:
    with Scratch(d.spark, "components") as s:
        t = s.table(d.tuples)
        return s.keep(f(t, s.table(comp.component_labels(t, s)), s))


# factors nest in D3 and D4: a component is a level of the first factor, and labels follow its order
_NESTED = ", comp AS (SELECT q, l, CAST(MIN(a) AS INTEGER) AS component FROM e GROUP BY q, l)"


@query("component_labels", "D3", _NESTED + " SELECT q, l, component FROM comp")
def component_labels(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: labels)


@query("component_labels_many", "D4", _NESTED + " SELECT q, l, component FROM comp")
def component_labels_many(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: labels)


@query("component_sizes", "D4", _NESTED + " SELECT component, CAST(SUM((q = 0)::INT) AS BIGINT) AS n0, CAST(SUM((q = 1)::INT) AS BIGINT) AS n1, CAST(SUM((q = 2)::INT) AS BIGINT) AS n2 FROM comp GROUP BY component")
def component_sizes(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: comp.component_sizes(labels))


@query("component_extrema", "D3", _NESTED + ", dg AS (SELECT q, l, SUM(w) AS d FROM e GROUP BY q, l), mw AS (SELECT a AS component, MIN(w) AS min_w, MAX(w) AS max_w FROM t GROUP BY a) SELECT component, ANY_VALUE(min_w) AS min_w, ANY_VALUE(max_w) AS max_w, MIN(d) AS min_d, MAX(d) AS max_d FROM dg JOIN comp USING (q, l) JOIN mw USING (component) GROUP BY component")
def component_extrema(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: linear.extrema_by_component(t, labels))


_PROJECTED = _NESTED + """, xs AS (SELECT q, l, component, CAST(l % 7 - 3 AS DOUBLE) AS x FROM comp),
    sm AS (SELECT component, SUM(CASE WHEN q = 0 THEN x ELSE 0 END) AS s0, SUM(CASE WHEN q = 1 THEN x ELSE 0 END) AS s1, SUM(CASE WHEN q = 2 THEN x ELSE 0 END) AS s2,
      SUM((q = 0)::INT)::DOUBLE AS n0, SUM((q = 1)::INT)::DOUBLE AS n1, SUM((q = 2)::INT)::DOUBLE AS n2 FROM xs GROUP BY component),
    sh AS (SELECT *, ((s0 - s1) * (n0 + n2) - n0 * (s0 - s2)) / ((n0 + n1) * (n0 + n2) - n0 * n0) AS p, ((n0 + n1) * (s0 - s2) - n0 * (s0 - s1)) / ((n0 + n1) * (n0 + n2) - n0 * n0) AS r FROM sm)"""


@query("structural_projection", "D3", _PROJECTED + " SELECT q, l, round(x - CASE q WHEN 0 THEN p + r WHEN 1 THEN -p ELSE -r END, 6) AS x FROM xs JOIN sh USING (component)")
def structural_projection(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: comp.project_structural(d.x(t), labels).withColumn("x", F.round("x", 6)))


@query("structural_defect", "D3", _PROJECTED + " SELECT component, greatest(abs(s0 - s1), abs(s0 - s2)) AS defect FROM sm")
def structural_defect(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: comp.structural_defect(d.x(t), labels))


@query("component_rhs", "D4", " SELECT q, l, SUM(w * (tid % 11 - 5)) AS rhs FROM e WHERE a = 3 GROUP BY q, l")
def component_rhs(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: linear.component_rhs(t.withColumn("y", (F.col("tid") % 11 - 5).cast("double")), labels, 3))


@query("component_local_codes", "D4", _NESTED + " SELECT q, l, component, CAST(row_number() OVER (PARTITION BY component, q ORDER BY l) - 1 AS INTEGER) AS local FROM comp")
def component_local_codes(d: Loaded) -> DataFrame:
    return _labelled(d, lambda t, labels, s: comp.local_codes(labels))


@query("kernel_rank_nullity", "D3", _NESTED + ", k AS (SELECT component, COUNT(*) AS v, SUM((q = 2)::INT) AS r FROM comp GROUP BY component) SELECT component, CAST(r AS BIGINT) AS rank, CAST(v - r AS BIGINT) AS nullity, v - r = 2 AS structural FROM k")
def kernel_rank_nullity(d: Loaded) -> DataFrame:
    """Exact, by peeling; in a nested design the rank is the number of finest levels."""
    return _labelled(d, lambda t, labels, s: kernel.rank_nullity(t, labels, s))


# --- transfer ---------------------------------------------------------------------------------------------

_HALF = ", m AS (SELECT a // 2 AS a, b // 2 AS b, c // 2 AS c, SUM(w) AS w, SUM(w2) AS w2 FROM t GROUP BY 1, 2, 3)"


@query("prolong", "D1", "SELECT q, l, CAST((l // 2) % 7 - 3 AS DOUBLE) AS x FROM lv", ("w",))
def prolong(d: Loaded) -> DataFrame:
    m = transfer.halving_map(d.levels(d.tuples))
    coarse = m.select("q", F.col("parent").alias("l")).distinct().withColumn("x", (F.col("l") % 7 - 3).cast("double"))
    return transfer.prolong(m, coarse)


@query("prolong_add", "D1", "SELECT q, l, CAST(l % 7 - 3 + (l // 2) % 7 - 3 AS DOUBLE) AS x FROM lv", ("w",))
def prolong_add(d: Loaded) -> DataFrame:
    t = d.tuples
    m = transfer.halving_map(d.levels(t))
    coarse = m.select("q", F.col("parent").alias("l")).distinct().withColumn("x", (F.col("l") % 7 - 3).cast("double"))
    return transfer.prolong_add(m, coarse, d.x(t))


@query("restrict", "D1", "SELECT q, l // 2 AS l, CAST(SUM(l % 7 - 3) AS DOUBLE) AS x FROM lv GROUP BY q, l // 2", ("w",))
def restrict(d: Loaded) -> DataFrame:
    t = d.tuples
    return transfer.restrict(transfer.halving_map(d.levels(t)), d.x(t))


@query("coarsen_halving", "D1", _HALF + " SELECT a, b, c, w FROM m", ("w",))
def coarsen_halving(d: Loaded) -> DataFrame:
    t = d.coded  # sums of sums: coarsening, like the marginals, needs neither numbers of tuples nor their sums first
    return transfer.coarsen(t, transfer.halving_map(d.levels(t)))


@query("coarsen_twice", "D1", "SELECT a // 4 AS a, b // 4 AS b, c // 4 AS c, SUM(w) AS w FROM t GROUP BY 1, 2, 3", ("w",))
def coarsen_twice(d: Loaded) -> DataFrame:
    t = d.coded
    m = transfer.halving_map(d.levels(t))
    return transfer.coarsen(t, transfer.composed(m, transfer.halving_map(m.select("q", F.col("parent").alias("l")).distinct())))


@query("galerkin_action", "D1", "SELECT q, l // 2 AS l, SUM(e.w * px) AS x FROM e JOIN (SELECT tid, ((a // 2) % 7 - 3) + ((b // 2) % 7 - 3) + ((c // 2) % 7 - 3) AS px FROM t) USING (tid) GROUP BY q, l // 2", ("w",))
def galerkin_action(d: Loaded) -> DataFrame:
    """P'GP x; equal to the action of the coarsened tuples."""
    t = d.tuples
    m = transfer.halving_map(d.levels(t))
    coarse = m.select("q", F.col("parent").alias("l")).distinct().withColumn("x", (F.col("l") % 7 - 3).cast("double"))
    return transfer.restrict(m, linear.gramian(t, transfer.prolong(m, coarse), "x"))


@query("coarse_weight_replay", "D1", _HALF + " SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS ctid, w2 AS w FROM m", ("w", "w2"))
def coarse_weight_replay(d: Loaded) -> DataFrame:
    t = d.tuples
    m = transfer.halving_map(d.levels(t))
    coarse = enc.canonical_tuples(transfer.coarsen(t, m), d.bound)
    return transfer.replay(t.select("tid", F.col("w2").alias("w")), transfer.coarse_map(t, m, coarse))


@query("hierarchy_weight_replay", "D1", ", m AS (SELECT a // 4 AS a, b // 4 AS b, c // 4 AS c, SUM(w2) AS w2 FROM t GROUP BY 1, 2, 3) SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS tid, w2 AS w FROM m", ("w", "w2"))
def hierarchy_weight_replay(d: Loaded) -> DataFrame:
    """The second generation of weights on the third level, through the plans of two halvings."""
    with Scratch(d.spark, "replay") as s:
        t = d.tuples if d.bound > ONE_TASK_ROWS else s.table(d.tuples)  # many are a table already
        whole = d.levels(t).withColumn("component", F.lit(0))  # halving ignores components
        h = transfer.Hierarchy(t, whole, s, strict=False)
        for _ in range(2):
            h.append(transfer.halving_map(h.labels[-1]))
        return s.keep(h.replay(t.select("tid", F.col("w2").alias("w")))[-1])


# --- pairs ------------------------------------------------------------------------------------------------

_PAIRS = ", pm AS (SELECT '12' AS pair, a AS u, b AS v, SUM(w) AS w FROM t GROUP BY a, b UNION ALL SELECT '13', a, c, SUM(w) FROM t GROUP BY a, c UNION ALL SELECT '23', b, c, SUM(w) FROM t GROUP BY b, c), pd AS (SELECT pair, 0 AS side, u AS l, SUM(w) AS d FROM pm GROUP BY pair, u UNION ALL SELECT pair, 1, v, SUM(w) FROM pm GROUP BY pair, v)"
query("pair_marginals", "D1", _PAIRS + " SELECT pair, u, v, w FROM pm", ("w",))(lambda d: pairs.pair_marginals(d.coded))
query("pair_degrees", "D1", _PAIRS + " SELECT pair, side, l, d FROM pd", ("w",))(lambda d: pairs.pair_degrees(pairs.pair_marginals(d.coded)))
query(
    "pair_signed_laplacian",
    "D2",
    _PAIRS + " SELECT pair, 0 AS i_side, u AS i, 1 AS j_side, v AS j, -w AS value FROM pm UNION ALL SELECT pair, 1, v, 0, u, -w FROM pm UNION ALL SELECT pair, side, l, side, l, d FROM pd",
)(lambda d: pairs.pair_laplacian(pairs.pair_marginals(d.tuples)))


@query(
    "pair_components",
    "D3",
    _PAIRS + ", pv AS (SELECT pair, 0 AS side, u AS l, MIN(u) AS r FROM pm WHERE pair <> '23' GROUP BY pair, u UNION ALL SELECT pair, 1, v, MIN(u) FROM pm WHERE pair <> '23' GROUP BY pair, v UNION ALL SELECT pair, 0, u, MIN(u) FROM pm WHERE pair = '23' GROUP BY pair, u UNION ALL SELECT pair, 1, v, MIN(u) FROM pm WHERE pair = '23' GROUP BY pair, v) SELECT pair, side, l, pair || ':0:' || lpad(r::VARCHAR, 12, '0') AS component FROM pv",
)
def pair_components(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "pairs") as s:
        return s.keep(pairs.pair_components(pairs.pair_marginals(d.tuples), s))


# --- candidates -------------------------------------------------------------------------------------------

_CONTEXT = """, ce AS (SELECT 0 AS q, a AS l, b AS c1, c AS c2, w FROM t UNION ALL SELECT 1, b, a, c, w FROM t UNION ALL SELECT 2, c, a, b, w FROM t),
    tp AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY q, c1, c2 ORDER BY w DESC, l) <= 16), dg AS (SELECT q, l, SUM(w) AS d FROM e GROUP BY q, l),
    ov AS (SELECT x.q, x.l, y.l AS r, SUM(least(x.w, y.w)) AS overlap FROM tp x JOIN tp y ON x.q = y.q AND x.c1 = y.c1 AND x.c2 = y.c2 AND x.l < y.l GROUP BY ALL)
    SELECT ov.q, ov.l, ov.r, overlap FROM ov JOIN dg m ON m.q = ov.q AND m.l = ov.l JOIN dg n ON n.q = ov.q AND n.l = ov.r WHERE overlap / sqrt(m.d * n.d) >= 0.15"""
query("context_candidates", "D5", _CONTEXT)(lambda d: cand.context_candidates(d.tuples).select("q", "l", "r", "overlap"))
_NEIGHBOR = """, ce AS (SELECT q, side, c, l, SUM(w) AS w FROM (SELECT 0 AS q, 1 AS side, b AS c, a AS l, w FROM t UNION ALL SELECT 0, 2, c, a, w FROM t UNION ALL SELECT 1, 0, a, b, w FROM t
      UNION ALL SELECT 1, 2, c, b, w FROM t UNION ALL SELECT 2, 0, a, c, w FROM t UNION ALL SELECT 2, 1, b, c, w FROM t) GROUP BY ALL)"""
query(
    "neighborhood_candidates",
    "D2",
    _NEIGHBOR
    + """, tp AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY q, side, c ORDER BY w DESC, l) <= 16), dg AS (SELECT q, l, SUM(w) * 2 AS d FROM e GROUP BY q, l),
    ov AS (SELECT x.q, x.l, y.l AS r, SUM(least(x.w, y.w)) AS overlap FROM tp x JOIN tp y ON x.q = y.q AND x.side = y.side AND x.c = y.c AND x.l < y.l GROUP BY ALL)
    SELECT ov.q, ov.l, ov.r, overlap, round(least(overlap / sqrt(m.d * n.d), 1.0), 6) AS affinity FROM ov JOIN dg m ON m.q = ov.q AND m.l = ov.l JOIN dg n ON n.q = ov.q AND n.l = ov.r WHERE overlap / sqrt(m.d * n.d) >= 0.02""",
)(lambda d: cand.neighborhood_candidates(d.tuples).withColumn("affinity", F.round("affinity", 6)))
query(
    "adjacent_pair_candidates",
    "D2",
    _NEIGHBOR + ", o AS (SELECT q, l, lead(l) OVER w AS nx, row_number() OVER w AS n FROM ce WINDOW w AS (PARTITION BY q, side, c ORDER BY w DESC, l)) SELECT DISTINCT q, least(l, nx) AS l, greatest(l, nx) AS r FROM o WHERE n % 2 = 1 AND nx IS NOT NULL",
)(lambda d: cand.adjacent_candidates(d.tuples))


#: Greedy matching by rounds: pairs that come first at both ends are taken, pairs with a taken end fall out.
_MATCHED = (
    _NEIGHBOR
    + """, tp AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY q, side, c ORDER BY w DESC, l) <= 16), dg AS (SELECT q, l, SUM(w) * 2 AS d FROM e GROUP BY q, l),
    ov AS (SELECT x.q, x.l, y.l AS r, SUM(least(x.w, y.w)) AS overlap FROM tp x JOIN tp y ON x.q = y.q AND x.side = y.side AND x.c = y.c AND x.l < y.l GROUP BY ALL),
    cd AS MATERIALIZED (SELECT ov.q, ov.l, ov.r, row_number() OVER (ORDER BY least(overlap / sqrt(m.d * n.d), 1.0) DESC, ov.l, ov.r) AS i FROM ov JOIN dg m ON m.q = ov.q AND m.l = ov.l JOIN dg n ON n.q = ov.q AND n.l = ov.r
      WHERE overlap / sqrt(m.d * n.d) >= 0.02),
    mt AS (SELECT q, l, r FROM (WITH RECURSIVE it AS (SELECT q, l, r, i, false AS taken FROM cd UNION ALL
      (WITH o AS (SELECT q, l, r, i FROM it WHERE NOT taken), en AS (SELECT q, l AS v, i FROM o UNION ALL SELECT q, r, i FROM o), be AS (SELECT q, v, MIN(i) AS i FROM en GROUP BY q, v),
        ch AS (SELECT o.q, o.l, o.r, o.i FROM o JOIN be x ON x.q = o.q AND x.v = o.l AND x.i = o.i JOIN be y ON y.q = o.q AND y.v = o.r AND y.i = o.i), ve AS (SELECT q, l AS v FROM ch UNION ALL SELECT q, r FROM ch)
        SELECT q, l, r, i, true FROM ch UNION ALL SELECT o.q, o.l, o.r, o.i, false FROM o WHERE NOT EXISTS (SELECT 1 FROM ve WHERE ve.q = o.q AND (ve.v = o.l OR ve.v = o.r)))) SELECT * FROM it WHERE taken)),
    hd AS (SELECT lv.q, lv.l, coalesce(mt.l, lv.l) AS head FROM lv LEFT JOIN mt ON mt.q = lv.q AND mt.r = lv.l)
    SELECT q, l, CAST(dense_rank() OVER (PARTITION BY q ORDER BY head) - 1 AS INTEGER) AS parent FROM hd"""
)


@query("greedy_matching_parents", "D2", _MATCHED)
def greedy_matching_parents(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "matching") as s:
        t = s.table(d.tuples)
        return s.keep(cand.matching_map(s.table(cand.neighborhood_candidates(t)), d.levels(t), s))


# --- smoothers and diagnostics ----------------------------------------------------------------------------


@query("jacobi_action", "D2", ", dg AS (SELECT q, l, SUM(w) AS d FROM e GROUP BY q, l) SELECT q, l, round(0.5 * (l % 7 - 3) / d, 12) AS x FROM dg")
def jacobi_action(d: Loaded) -> DataFrame:
    t = d.tuples
    return smoothers.jacobi(t, d.x(t)).withColumn("x", F.round("x", 12))


_SWEEP = """, d0 AS (SELECT a, SUM(w) AS d FROM t GROUP BY a), d1 AS (SELECT b, SUM(w) AS d FROM t GROUP BY b), d2 AS (SELECT c, SUM(w) AS d FROM t GROUP BY c),
    z0 AS (SELECT a, (a % 7 - 3) / d AS z FROM d0), z1 AS (SELECT b, (ANY_VALUE(b % 7 - 3) - SUM(t.w * z0.z)) / ANY_VALUE(d1.d) AS z FROM t JOIN z0 USING (a) JOIN d1 USING (b) GROUP BY b),
    z2 AS (SELECT c, (ANY_VALUE(c % 7 - 3) - SUM(t.w * (z0.z + z1.z))) / ANY_VALUE(d2.d) AS z FROM t JOIN z0 USING (a) JOIN z1 USING (b) JOIN d2 USING (c) GROUP BY c)"""


@query("map_forward_sweep", "D2", _SWEEP + " SELECT 0 AS q, a AS l, round(z, 9) AS x FROM z0 UNION ALL SELECT 1, b, round(z, 9) FROM z1 UNION ALL SELECT 2, c, round(z, 9) FROM z2")
def map_forward_sweep(d: Loaded) -> DataFrame:
    t = d.tuples
    return smoothers.block_solve(t, d.x(t)).withColumn("x", F.round("x", 9))


@query(
    "map_symmetric_sweep",
    "D2",
    _SWEEP
    + """, y1 AS (SELECT b, ANY_VALUE(z1.z) - SUM(t.w * z2.z) / ANY_VALUE(d1.d) AS z FROM t JOIN z2 USING (c) JOIN z1 USING (b) JOIN d1 USING (b) GROUP BY b),
    y0 AS (SELECT a, ANY_VALUE(z0.z) - SUM(t.w * (z2.z + y1.z)) / ANY_VALUE(d0.d) AS z FROM t JOIN z2 USING (c) JOIN y1 USING (b) JOIN z0 USING (a) JOIN d0 USING (a) GROUP BY a)
    SELECT 0 AS q, a AS l, round(z, 8) AS x FROM y0 UNION ALL SELECT 1, b, round(z, 8) FROM y1 UNION ALL SELECT 2, c, round(z, 8) FROM z2""",
)
def map_symmetric_sweep(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "sweep") as s:
        t = s.table(d.tuples)
        return s.keep(smoothers.symmetric_map(t, d.x(t)).withColumn("x", F.round("x", 8)))


@query(
    "compatible_projection",
    "D2",
    ", dg AS (SELECT q, l, CAST(l % 7 - 3 AS DOUBLE) AS x, SUM(w) AS d FROM e GROUP BY q, l) SELECT q, l, round(x - SUM(d * x) OVER w / SUM(d) OVER w, 9) AS x FROM dg WINDOW w AS (PARTITION BY q, l // 2)",
)
def compatible_projection(d: Loaded) -> DataFrame:
    t = d.tuples
    return smoothers.compatible_projection(t, d.x(t), transfer.halving_map(d.levels(t))).withColumn("x", F.round("x", 9))


# --- solves -----------------------------------------------------------------------------------------------


def _fit(d: Loaded, options: solve.Options, what: str = "fitted", unit: bool = False) -> DataFrame:
    with Scratch(d.spark, "fit", numbers=True) as s:
        t = s.table(d.tuples.select("tid", "a", "b", "c", "w", "y")) if unit else d.means(s)
        labels = comp.component_labels(t, s)
        coefficients, report = solve.fit(t, labels, ["y"], s, options)
        if what == "report":
            return s.keep(report.select("k", "routes", "accepted", "global_fallback", (F.col("ratio") <= 1e-8).alias("certified")))
        return s.keep(solve.fitted_values(t, coefficients).select("tid", F.round("fitted", 4).alias("fitted")))


_BALANCED = "SELECT CAST(tid AS BIGINT) AS tid, round(AVG(y) OVER (PARTITION BY a) + AVG(y) OVER (PARTITION BY b) + AVG(y) OVER (PARTITION BY c) - 2 * AVG(y) OVER (), 4) AS fitted FROM t"
for _name, _options in (("automatic", solve.Options()), ("lsmr_map", solve.Options("lsmr")), ("pcg_diagonal", solve.Options("pcg", "diagonal")), ("lsmr_pair_schwarz", solve.Options("lsmr", "pair_schwarz")), ("pcg_identity", solve.Options("pcg", "identity"))):
    query(f"fitted_balanced_{_name}", "D6", _BALANCED)(lambda d, o=_options: _fit(d, o, unit=True))
_NESTED_FIT = "SELECT CAST(tid AS BIGINT) AS tid, round(CAST(wy AS DOUBLE) / w, 4) AS fitted FROM t"
query("fitted_nested", "D3", _NESTED_FIT)(lambda d: _fit(d, solve.Options()))
query("fitted_nested_many", "D4", _NESTED_FIT)(lambda d: _fit(d, solve.Options()))
query("fitted_nested_distributed", "D3", _NESTED_FIT)(lambda d: _fit(d, solve.Options(task_tuples=0)))
for _design in ("D1", "D2", "D5"):
    query(f"automatic_report_{_design.lower()}", _design, "SELECT 0 AS k, CASE WHEN (SELECT COUNT(*) FROM lv) <= 256 THEN 'dense' ELSE 'hierarchy' END AS routes, true AS accepted, false AS global_fallback, true AS certified" if _design != "D1" else None, ("w", "y"))(lambda d: _fit(d, solve.Options(), "report"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, collapse, find components, solve, certify, and scatter fitted values of D2 to its observations."""
    d = Loaded(spark, observations(spark, sf_dir, "D2"), row_bound(spark, sf_dir, "D2"))
    with Scratch(spark, "flagship", numbers=True) as s:
        topology = enc.encode(d.obs, DESIGN, d.bound)
        rows = s.table(topology.observations.select("row_id", "tid", "a", "b", "c", "w", "y"))
        t = rows.groupBy("tid", "a", "b", "c").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
        t = s.table(t)
        coefficients, report = solve.fit(t, comp.component_labels(t, s), ["y"], s)
        if not report.where("NOT accepted").isEmpty():
            raise RuntimeError("a column was not certified")
        fitted = solve.fitted_values(t, coefficients).select("tid", F.round("fitted", 4).alias("fitted"))
        return s.keep(rows.select("row_id", "tid").join(fitted, "tid").select("row_id", "fitted"))


QUERIES["flagship_fit"] = flagship
