"""Named queries of the operators that work on whole tables: batches of columns, the grouped layout, exact sums, pair plans, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.operators import candidates as cand
from triweave.operators import components as comp
from triweave.operators import encode as enc
from triweave.operators import linear, transfer
from triweave.operators.columns import Columns, at
from triweave.operators.exact import refuse_overflow
from triweave.operators.pairs import PAIRS, PairPlan
from triweave.plans import batch, screening, solve
from triweave.plans.queries import _NEIGHBOR, _PAIRS, _SWEEP, Loaded, query
from triweave.plans.scratch import Scratch

# --- batches: fits on tables, no task holds a component -----------------------------------------------------


def _targets(n: int) -> list:
    """y + j (tid % (j + 2)) for j below n."""
    return [(F.col("y") + F.lit(j) * (F.col("tid") % (j + 2))).cast("double").alias(f"y{j}") for j in range(n)]


def _fitted(d: Loaded, n: int, options: solve.Options) -> DataFrame:
    with Scratch(d.spark, "batch") as s:
        t = s.table(d.tuples.select("tid", "a", "b", "c", "w", *_targets(n)))
        names = [f"y{j}" for j in range(n)]
        coefficients, report = solve.fit(t, comp.component_labels(t, s), names, s, options)
        if not report.where("NOT accepted OR global_fallback").isEmpty():
            raise RuntimeError("a column was not certified")
        x = coefficients.groupBy("q", "l").agg(F.array(*(F.max(F.when(F.col("k") == j, F.col("x"))) for j in range(n))).alias("x"))
        rows = Columns(t, n, s).image(x).select("tid", F.posexplode("bx").alias("k", "fitted"))
        return s.keep(rows.select("tid", "k", (F.round("fitted", 4) + F.lit(0.0)).alias("fitted")))


def _balanced_sql(n: int) -> str:
    """In a balanced design the fit is the sum of the factors' means less twice the mean."""
    means = "AVG(v) OVER (PARTITION BY k, a) + AVG(v) OVER (PARTITION BY k, b) + AVG(v) OVER (PARTITION BY k, c) - 2 * AVG(v) OVER (PARTITION BY k)"
    return f", s AS (SELECT tid, a, b, c, k, y + k * (tid % (k + 2)) AS v FROM t, (SELECT unnest(range({n})) AS k)) SELECT CAST(tid AS BIGINT) AS tid, CAST(k AS INTEGER) AS k, round({means}, 4) + 0.0 AS fitted FROM s"


for _n in (1, 4, 32):
    query(f"fitted_balanced_batch_{_n}", "D6", _balanced_sql(_n))(lambda d, n=_n: _fitted(d, n, solve.Options(task_tuples=0)))
query("fitted_balanced_lsmr_tables", "D6", _balanced_sql(3))(lambda d: _fitted(d, 3, solve.Options("lsmr", task_tuples=0)))
query("fitted_balanced_pcg_tables", "D6", _balanced_sql(3))(lambda d: _fitted(d, 3, solve.Options("pcg", "diagonal", task_tuples=0)))


@query(
    "batch_certificates",
    "D1",
    """, s AS (SELECT k, q, l, SUM(e.w * (e.tid % (k + 11) - 5 - (k + 1) * bx)) AS r, SUM(e.w * (e.tid % (k + 11) - 5)) AS b FROM e JOIN (SELECT tid, bx FROM bx) USING (tid), (SELECT unnest(range(4)) AS k) GROUP BY k, q, l)
    SELECT CAST(k AS INTEGER) AS k, round(sqrt(SUM(r * r)), 5) AS residual_norm, round(sqrt(SUM(b * b)), 5) AS rhs_norm FROM s GROUP BY k""",
    ("w",),
)
def batch_certificates(d: Loaded) -> DataFrame:
    """Four columns' residuals of given coefficients in one job."""
    with Scratch(d.spark, "certificates") as s:
        t = d.tuples.select("tid", "a", "b", "c", "w", *((F.col("tid") % (k + 11) - 5).cast("double").alias(f"y{k}") for k in range(4)))
        x = d.x(t).select("q", "l", F.array(*(F.col("x") * (k + 1) for k in range(4))).alias("x"))
        row = batch.certificate_sums(t, x, [f"y{k}" for k in range(4)], s)
        each = F.array(*(F.struct(F.lit(k).alias("k"), F.round(F.sqrt(f"r{k}"), 5).alias("residual_norm"), F.round(F.sqrt(f"b{k}"), 5).alias("rhs_norm")) for k in range(4)))
        return s.keep(row.select(F.explode(each).alias("e")).select("e.*"))


# --- the layout by factor -----------------------------------------------------------------------------------


@query("gramian_grouped", "D1", "SELECT q, l, SUM(e.w * bx) AS gx, 3 * SUM(e.w * bx) AS gx3 FROM e JOIN (SELECT tid, bx FROM bx) USING (tid) GROUP BY q, l", ("w",))
def gramian_grouped(d: Loaded) -> DataFrame:
    """Two columns through the tuples laid out by factor."""
    with Scratch(d.spark, "grouped") as s:
        t = s.table(d.tuples)
        x = s.table(d.x(t).select("q", "l", F.array("x", 3 * F.col("x")).alias("x")))
        with Columns(t, 2, s, grouped=True) as op:
            return s.keep(op.gramian(x).select("q", "l", at("x", 0).alias("gx"), at("x", 1).alias("gx3")))


@query(
    "map_sweep_grouped",
    "D2",
    _SWEEP
    + """, y1 AS (SELECT b, ANY_VALUE(z1.z) - SUM(t.w * z2.z) / ANY_VALUE(d1.d) AS z FROM t JOIN z2 USING (c) JOIN z1 USING (b) JOIN d1 USING (b) GROUP BY b),
    y0 AS (SELECT a, ANY_VALUE(z0.z) - SUM(t.w * (z2.z + y1.z)) / ANY_VALUE(d0.d) AS z FROM t JOIN z2 USING (c) JOIN y1 USING (b) JOIN z0 USING (a) JOIN d0 USING (a) GROUP BY a)
    SELECT 0 AS q, a AS l, round(z, 8) AS x FROM y0 UNION ALL SELECT 1, b, round(z, 8) FROM y1 UNION ALL SELECT 2, c, round(z, 8) FROM z2""",
)
def map_sweep_grouped(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "grouped") as s:
        t = s.table(d.tuples)
        x = s.table(d.x(t).select("q", "l", F.array("x").alias("x")))
        with Columns(t, 1, s, grouped=True) as op:
            return s.keep(op.symmetric_map(x, linear.degrees(t)).select("q", "l", F.round(at("x", 0), 8).alias("x")))


@query(
    "component_layout",
    "D4",
    ", comp AS (SELECT q, l, CAST(MIN(a) AS INTEGER) AS component FROM e GROUP BY q, l) SELECT q, l, component, CAST(row_number() OVER (ORDER BY component, q, l) - 1 AS BIGINT) AS position, CAST(l % 7 - 3 AS DOUBLE) AS x FROM comp",
)
def component_layout(d: Loaded) -> DataFrame:
    """Positions, with coefficients gathered to them and scattered back."""
    with Scratch(d.spark, "layout") as s:
        t = s.table(d.tuples)
        layout = comp.ComponentLayout(comp.component_labels(t, s), s)
        back = layout.scatter(layout.gather(d.x(t)).select("position", "x"))
        return s.keep(layout.positions.join(back, ["q", "l"]).select("q", "l", "component", "position", "x"))


# --- exact sums ---------------------------------------------------------------------------------------------

#: Weights of 1 to 7 times a power of two up to 2^40: the sums are whole numbers that doubles hold only after one rounding.
_SPREAD_SQL = "(CAST(row_id % 16 AS BIGINT) << CAST((row_id // 16) % 41 AS INTEGER))"


def _spread(d: Loaded) -> DataFrame:
    line, order = F.col("row_id") % 16, F.floor(F.col("row_id") / 16)
    return d.coded.withColumn("w", line.cast("double") * F.pow(F.lit(2.0), (order % 41).cast("double")))


@query("exact_collapse", "D3", f"SELECT a, b, c, CAST(SUM({_SPREAD_SQL})::BIGINT AS DOUBLE) AS w, CAST(COUNT(*) AS BIGINT) AS n_obs FROM coded GROUP BY a, b, c")
def exact_collapse(d: Loaded) -> DataFrame:
    return enc.exact_collapse(_spread(d), "w")


@query("exact_energy", "D3", f", s AS (SELECT a, b, c, SUM({_SPREAD_SQL})::BIGINT AS v FROM coded GROUP BY a, b, c) SELECT CAST(SUM(CAST(CAST(v AS DOUBLE) AS HUGEINT) * (a % 2 + b % 2) * (a % 2 + b % 2))::BIGINT AS DOUBLE) AS energy FROM s")
def exact_energy(d: Loaded) -> DataFrame:
    """Tuples of very different weight; each term is a weight times 0, 1 or 4, so only the sum can be inexact."""
    with Scratch(d.spark, "energy") as s:
        t = s.table(enc.exact_collapse(_spread(d), "w"))
        x = linear.edges(t).distinct().withColumn("x", F.when(F.col("q") < 2, F.col("l") % 2).otherwise(0).cast("double"))
        return s.keep(linear.exact_energy(t, x))


_SECOND = f", g AS (SELECT a, b, c, SUM({_SPREAD_SQL})::BIGINT AS v FROM coded GROUP BY a, b, c), gt AS (SELECT t.tid, t.a, t.b, t.c, CAST(g.v AS DOUBLE)::BIGINT AS v FROM t JOIN g USING (a, b, c))"


def _second(d: Loaded, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(tuples, weights of a second generation)."""
    t = s.table(d.tuples.select("tid", "a", "b", "c", "w"))
    return t, s.table(enc.exact_collapse(_spread(d), "w").join(t.drop("w"), ["a", "b", "c"]).select("tid", "w"))


@query("exact_weight_replay", "D5", _SECOND + ", m AS (SELECT a // 2 AS a, b // 2 AS b, c // 2 AS c, CAST(SUM(v)::BIGINT AS DOUBLE) AS w FROM gt GROUP BY 1, 2, 3) SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS ctid, w FROM m")
def exact_weight_replay(d: Loaded) -> DataFrame:
    """A second generation of weights through a coarse merge plan, exactly."""
    with Scratch(d.spark, "replay") as s:
        t, w = _second(d, s)
        m = transfer.halving_map(d.levels(t))
        coarse = s.table(enc.canonical_tuples(transfer.coarsen(t, m), d.bound))
        return s.keep(refuse_overflow(s.table(transfer.exact_replay(w, transfer.coarse_map(t, m, coarse))), ["w"], "coarse tuple total"))


# --- pair plans ---------------------------------------------------------------------------------------------


@query("pair_plan", "D2", _PAIRS.replace("SUM(w) AS w", "0 AS w").replace("SUM(w)", "0") + ", ed AS (SELECT CAST(row_number() OVER (ORDER BY pair, u, v) - 1 AS BIGINT) AS edge, pair, u, v FROM pm) SELECT CAST(t.tid AS BIGINT) AS tid, edge FROM t JOIN ed ON (pair = '12' AND u = a AND v = b) OR (pair = '13' AND u = a AND v = c) OR (pair = '23' AND u = b AND v = c)")
def pair_plan(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "pairs") as s:
        return s.keep(PairPlan(s.table(d.tuples), s).plan)


_EDGES = _SECOND + "".join(f", p{p} AS (SELECT '{p}' AS pair, {'abc'[i]} AS u, {'abc'[j]} AS v, CAST(SUM(v)::BIGINT AS DOUBLE) AS w FROM gt GROUP BY {'abc'[i]}, {'abc'[j]})" for p, i, j in PAIRS) + ", pe AS (SELECT * FROM p12 UNION ALL SELECT * FROM p13 UNION ALL SELECT * FROM p23)"


@query("pair_conductance_replay", "D5", _EDGES + " SELECT CAST(row_number() OVER (ORDER BY pair, u, v) - 1 AS BIGINT) AS edge, pair, u, v, w FROM pe")
def pair_conductance_replay(d: Loaded) -> DataFrame:
    """A second generation of weights on the three pair graphs, through the plan made for the topology."""
    with Scratch(d.spark, "pairs") as s:
        t, w = _second(d, s)
        return s.keep(PairPlan(t, s).conductances(w))


@query("pair_degree_replay", "D5", _EDGES + " SELECT pair, 0 AS side, u AS l, CAST(SUM(w::BIGINT)::BIGINT AS DOUBLE) AS d FROM pe GROUP BY pair, u UNION ALL SELECT pair, 1, v, CAST(SUM(w::BIGINT)::BIGINT AS DOUBLE) FROM pe GROUP BY pair, v")
def pair_degree_replay(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "pairs") as s:
        t, w = _second(d, s)
        plan = PairPlan(t, s)
        return s.keep(plan.degrees(plan.conductances(w)))




# --- learned candidates and repair -----------------------------------------------------------------------------

#: Two vectors of whole numbers by level, for candidates, scores and repairs that SQL can follow.
_VECTORS = ", sv AS (SELECT q, l, CAST((l * 37) % 101 - 50 AS DOUBLE) AS x0, CAST((l * 53) % 97 - 48 AS DOUBLE) AS x1 FROM lv)"
_NEAR = (
    _VECTORS
    + """, pl AS (SELECT i, q, l, row_number() OVER (PARTITION BY i, q ORDER BY v, l) AS n FROM (SELECT 0 AS i, q, l, x0 AS v FROM sv UNION ALL SELECT 1, q, l, x1 FROM sv)),
    nr AS (SELECT x.q, least(x.l, y.l) AS l, greatest(x.l, y.l) AS r, 1 - (MIN(y.n - x.n) - 1) / 3.0::DOUBLE AS near FROM pl x JOIN pl y ON x.i = y.i AND x.q = y.q AND y.n > x.n AND y.n <= x.n + 3 GROUP BY ALL)"""
)


def _vectors(d: Loaded, t: DataFrame) -> DataFrame:
    x = ((F.col("l") * 37) % 101 - 50).cast("double"), ((F.col("l") * 53) % 97 - 48).cast("double")
    return d.levels(t).select("q", "l", F.array(*x).alias("x"))


@query("signature_pairs", "D2", _NEAR + " SELECT q, l, r, round(near, 9) AS near FROM nr")
def signature_pairs(d: Loaded) -> DataFrame:
    """Levels near each other in the order of a vector; the design has one component."""
    with Scratch(d.spark, "learned") as s:
        t = s.table(d.tuples)
        labels = s.table(comp.component_labels(t, s))
        return s.keep(cand.signature_pairs(_vectors(d, t), labels, 2, s).withColumn("near", F.round("near", 9)))


@query(
    "learned_scores",
    "D2",
    _NEIGHBOR
    + _NEAR
    + """, tp AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY q, side, c ORDER BY w DESC, l) <= 16), dg AS (SELECT q, l, SUM(w) AS d FROM e GROUP BY q, l),
    ov AS (SELECT x.q, x.l, y.l AS r, SUM(least(x.w, y.w)) AS overlap FROM tp x JOIN tp y ON x.q = y.q AND x.side = y.side AND x.c = y.c AND x.l < y.l GROUP BY ALL),
    af AS (SELECT ov.q, ov.l, ov.r, least(overlap / sqrt(4 * m.d * n.d), 1.0) AS affinity FROM ov JOIN dg m ON m.q = ov.q AND m.l = ov.l JOIN dg n ON n.q = ov.q AND n.l = ov.r WHERE overlap / sqrt(4 * m.d * n.d) >= 0.02),
    sc AS (SELECT q, l, r, 0.55 * CASE WHEN (a.x0 * a.x0 + a.x1 * a.x1) * (b.x0 * b.x0 + b.x1 * b.x1) > 0 THEN pow(a.x0 * b.x0 + a.x1 * b.x1, 2) / ((a.x0 * a.x0 + a.x1 * a.x1) * (b.x0 * b.x0 + b.x1 * b.x1)) ELSE 0 END
      + 0.25 * coalesce(affinity, 0) + 0.10 * least(m.d, n.d) / greatest(m.d, n.d) + 0.10 * coalesce(near, 0) AS affinity
      FROM af FULL JOIN nr USING (q, l, r) JOIN sv a USING (q, l) JOIN dg m USING (q, l) JOIN (SELECT q, l AS r, x0, x1 FROM sv) b USING (q, r) JOIN (SELECT q, l AS r, d FROM dg) n USING (q, r))
    SELECT q, l, r, round(affinity, 6) AS affinity FROM sc WHERE affinity >= 0.35""",
)
def learned_scores(d: Loaded) -> DataFrame:
    with Scratch(d.spark, "learned") as s:
        t = s.table(d.tuples)
        labels, x, degrees = s.table(comp.component_labels(t, s)), s.table(_vectors(d, t)), s.table(linear.degrees(t))
        near = s.table(cand.signature_pairs(x, labels, 2, s))
        scores = cand.learned_scores(s.table(cand.neighborhood_candidates(t)), near, x, degrees, 2)
        return s.keep(scores.withColumn("affinity", F.round("affinity", 6)))


@query(
    "split_repair",
    "D2",
    _VECTORS
    + """, own AS (SELECT q, l, l // 8 AS parent, x0 AS x, SUM(w) AS d FROM sv JOIN e USING (q, l) GROUP BY ALL),
    en AS (SELECT q, parent, SUM(d * x * x) - SUM(d * x) * SUM(d * x) / SUM(d) AS energy FROM own GROUP BY q, parent HAVING COUNT(*) > 1), wo AS (SELECT q, parent FROM en ORDER BY energy DESC, q, parent LIMIT 1),
    ins AS (SELECT q, l, x, x - lag(x) OVER (ORDER BY x, l) AS gap FROM own JOIN wo USING (q, parent)), cut AS (SELECT x, l FROM ins WHERE gap IS NOT NULL ORDER BY gap DESC, x, l LIMIT 1),
    aft AS (SELECT ins.q, ins.l FROM ins, cut WHERE (ins.x, ins.l) >= (cut.x, cut.l))
    SELECT q, l, CAST(CASE WHEN aft.l IS NULL THEN parent ELSE (SELECT MAX(o.parent) + 1 FROM own o WHERE o.q = (SELECT q FROM wo)) END AS INTEGER) AS parent FROM own LEFT JOIN aft USING (q, l)""",
)
def split_repair(d: Loaded) -> DataFrame:
    """The aggregate of eight levels that holds most of a witness, split at its largest gap."""
    with Scratch(d.spark, "repair") as s:
        t = s.table(d.tuples)
        m = s.table(d.levels(t).select("q", "l", F.floor(F.col("l") / 8).cast("int").alias("parent")))
        witness = s.table(_vectors(d, t).select("q", "l", at("x", 0).alias("x")))
        return s.keep(screening.split_repair(m, witness, s.table(linear.degrees(t))))


# --- fits of a crossed design, against alternating weighted means ---------------------------------------------

_CENTRED = "SELECT step, tid, a, b, c, w, r - SUM(w * r) OVER z / SUM(w) OVER z AS r FROM ({inner}) WINDOW z AS (PARTITION BY {factor})"


def _alternating_sql(rounds: int) -> str:
    """What ``rounds`` sweeps of weighted means over the factors leave is the residual; fitted values in thousands."""
    inner = f"SELECT step + 1 AS step, tid, a, b, c, w, r FROM it WHERE step < {rounds}"
    for factor in "abc":
        inner = _CENTRED.format(inner=inner, factor=factor)
    return f""", s AS (SELECT tid, a, b, c, w, CAST(wy AS DOUBLE) / w AS v FROM t),
      rs AS (SELECT tid, r FROM (WITH RECURSIVE it AS (SELECT 0 AS step, tid, a, b, c, w, v AS r FROM s UNION ALL {inner}) SELECT tid, r FROM it WHERE step = {rounds}))
    SELECT CAST(tid AS BIGINT) AS tid, round((v - r) / 1000, 1) + 0.0 AS fitted FROM s JOIN rs USING (tid)"""


def _crossed(d: Loaded, options: solve.Options, route: str) -> DataFrame:
    with Scratch(d.spark, "crossed", numbers=True) as s:
        t = d.means(s)
        coefficients, report = solve.fit(t, comp.component_labels(t, s), ["y"], s, options)
        made = report.first()
        # components beyond a task leave the named route for the tables
        if not made.accepted or made.global_fallback or not set(made.routes.split(",")) <= {route, "distributed", "hierarchy"}:
            raise RuntimeError(f"not by its route: {made}")
        return s.keep(solve.fitted_values(t, coefficients).select("tid", (F.round(F.col("fitted") / 1000, 1) + F.lit(0.0)).alias("fitted")))


query("fitted_crossed_tables", "D1", _alternating_sql(80), ("w", "y"))(lambda d: _crossed(d, solve.Options(tolerance=1e-11, task_tuples=0), "distributed"))
query("fitted_crossed_lsmr_tables", "D2", _alternating_sql(80))(lambda d: _crossed(d, solve.Options("lsmr", tolerance=1e-11, task_tuples=0), "distributed"))
query("fitted_crossed_task", "D1", _alternating_sql(80), ("w", "y"))(lambda d: _crossed(d, solve.Options("lsmr", tolerance=1e-11, task_tuples=4_000_000), "lsmr:map"))
