"""Batches of columns on tables against dense least squares, single columns, and the grouped layout's plans."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators import components, linear, smoothers
from triweave.operators.columns import Columns, at
from triweave.plans import batch
from triweave.plans.scratch import Scratch


def problem(spark, scratch, n=60, k=4, seed=0, sizes=(5, 4, 6)):
    """(tuples table, labels, keys, w, targets): two components, one of them one tuple."""
    rng = np.random.default_rng(seed)
    keys = np.unique(np.column_stack([rng.integers(0, s, n) for s in sizes]), axis=0)
    keys = np.vstack([keys, np.array(sizes)])  # a tuple of its own
    w, y = rng.integers(1, 9, len(keys)) / 4, rng.standard_normal((len(keys), k))
    rows = [(i, *map(int, t), float(w[i]), *map(float, y[i])) for i, t in enumerate(keys)]
    tuples = scratch.table(spark.createDataFrame(rows, "tid long, a int, b int, c int, w double, " + ", ".join(f"y{i} double" for i in range(k))))
    return tuples, scratch.table(components.component_labels(tuples, scratch)), keys, w, y


def dense_fit(keys, w, y):
    b = np.column_stack([(keys[:, q][:, None] == np.unique(keys[:, q])[None, :]).astype(float) for q in range(3)])
    root = np.sqrt(w)[:, None]
    return b @ np.linalg.lstsq(b * root, y * root, rcond=None)[0]


def fitted(tuples, run, k):
    with Scratch(tuples.sparkSession, "check") as s:
        rows = Columns(tuples, k, s).image(run.coefficients).select("tid", "bx").collect()
    return np.array([r.bx for r in sorted(rows, key=lambda r: r.tid)])


def jobs_of(spark, f):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


@pytest.mark.parametrize("solver", ["pcg", "lsmr"])
def test_all_columns_equal_dense_least_squares(spark, solver):
    with Scratch(spark, "batch") as s:
        k = 4 if solver == "lsmr" else 3
        tuples, labels, keys, w, y = problem(spark, s, k=k)
        names = [f"y{i}" for i in range(k)]
        run = batch.lsmr(tuples, labels, names, s, tol=1e-12, certificate=1e-10, most=60) if solver == "lsmr" else batch.pcg(tuples, labels, names, s, rel=1e-11, most=80)
        assert all(run.converged), run.stops
        assert np.allclose(fitted(tuples, run, k), dense_fit(keys, w, y), atol=1e-7)
        assert (batch.certificates(tuples, run.coefficients, names, s) <= 1e-8).all()
        defects = [components.structural_defect(run.coefficients.select("q", "l", at("x", i).alias("x")), labels).agg(F.max("defect")).first()[0] for i in range(1)]
        assert max(defects) < 1e-9


def test_thirty_two_columns_take_the_jobs_of_one_and_equal_it(spark):
    with Scratch(spark, "batch") as s:
        tuples, labels, *_ = problem(spark, s, k=32, n=25, sizes=(3, 3, 3))
        names = [f"y{i}" for i in range(32)]
        # a fixed number of steps for both, so that only the columns differ
        one, jobs_one = jobs_of(spark, lambda: batch.pcg(tuples, labels, names[5:6], s, rel=1e-30, most=3))
        many, jobs_many = jobs_of(spark, lambda: batch.pcg(tuples, labels, names, s, rel=1e-30, most=3))
        assert jobs_many <= jobs_one and many.stops == ["iteration limit"] * 32
        assert np.allclose(fitted(tuples, many, 32)[:, 5], fitted(tuples, one, 1)[:, 0], rtol=1e-12, atol=1e-12)
        with pytest.raises(ModelError, match="number of targets"):
            batch.pcg(tuples, labels, [*names, "w"], s)


def test_the_gate_vetoes_a_stop_and_the_run_goes_on(spark):
    with Scratch(spark, "batch") as s:
        tuples, labels, keys, w, y = problem(spark, s, k=2, seed=3)
        # 0 is a column that is done at once
        tuples = s.table(tuples.withColumn("y0", F.lit(0.0)))
        loose = batch.lsmr(tuples, labels, ["y0", "y1"], s, tol=0.2, certificate=None, most=40)
        gated = batch.lsmr(tuples, labels, ["y0", "y1"], s, tol=0.2, certificate=1e-9, most=40)
        assert loose.stops == gated.stops == ["zero rhs", "converged"]
        assert gated.vetoes[1] >= 1 and gated.iterations[1] > loose.iterations[1] and gated.iterations[0] == 0
        assert batch.certificates(tuples, loose.coefficients, ["y0", "y1"], s)[1] > 1e-9
        y[:, 0] = 0
        assert np.allclose(fitted(tuples, gated, 2), dense_fit(keys, w, y), atol=1e-7)


def test_grouped_layout_moves_no_tuple_and_changes_nothing(spark):
    with Scratch(spark, "batch") as s:
        tuples, labels, *_ = problem(spark, s, k=2)
        x = s.table(linear.edges(tuples).distinct().select("q", "l", F.array(F.col("l") % 7 - 3.0, F.col("l") * 0.5 + F.col("q")).alias("x")))
        d = linear.degrees(tuples)
        plain = Columns(tuples, 2, s)
        with Columns(tuples, 2, s, grouped=True) as grouped:
            for made in (lambda op: op.gramian(x), lambda op: op.symmetric_map(x, d)):
                rows = [{(r.q, r.l): r.x for r in made(op).collect()} for op in (plain, grouped)]
                assert rows[0].keys() == rows[1].keys() and all(np.allclose(rows[0][key], rows[1][key]) for key in rows[0])
            plan = grouped.gramian(x)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 9
            assert "Exchange hashpartitioning" in plain.gramian(x)._jdf.queryExecution().executedPlan().toString()
            names = list(grouped.names)
        assert not [t for t in spark.catalog.listTables() if t.name in names]
        # column by column as the operators of one column
        for i in range(2):
            one = x.select("q", "l", at("x", i).alias("x"))
            for got, want in ((plain.gramian(x), linear.gramian(tuples, one, "x")), (plain.symmetric_map(x, d), smoothers.symmetric_map(tuples, one)), (plain.project(x, labels), components.project_structural(one, labels))):
                left = {(r.q, r.l): r.x[i] for r in got.collect()}
                right = {(r.q, r.l): r.x for r in want.collect()}
                assert left.keys() == right.keys() and all(abs(left[key] - right[key]) < 1e-9 for key in left)


def test_certificates_of_missing_and_zero_columns(spark):
    with Scratch(spark, "batch") as s:
        tuples, labels, *_ = problem(spark, s, k=3)
        tuples = tuples.withColumn("y1", F.lit(0.0))
        x = linear.edges(tuples).distinct().select("q", "l", F.array(F.lit(0.0), F.lit(0.0), F.when(F.col("q") == 0, 1.0)).alias("x"))
        assert batch.certificates(tuples, x, ["y0", "y1", "y2"], s).tolist() == [1.0, 0.0, np.inf]
