"""What a fit writes of its tuples, and which components a task takes beyond a hierarchy's memory."""

import numpy as np

from triweave.operators import components
from triweave.plans import solve
from triweave.plans.scratch import ARROW_ROWS, HASH_JOINS, Scratch


def crossed(spark, s, sizes=(6, 5, 4), n=60):
    rng = np.random.default_rng(8)
    keys = np.unique(np.column_stack([rng.integers(0, m, n) for m in sizes]), axis=0)
    keys = np.column_stack([np.unique(keys[:, q], return_inverse=True)[1] for q in range(3)])
    rows = [(i, *map(int, k), float(1 + i % 3), float(i % 7)) for i, k in enumerate(keys)]
    t = s.table(spark.createDataFrame(rows, "tid long, a int, b int, c int, w double, y double"))
    return t, s.table(components.component_labels(t, s))


def test_a_fit_of_a_table_writes_no_tuple_again(spark, monkeypatch):
    before = {k: spark.conf.get(k) for k in (ARROW_ROWS, HASH_JOINS)}
    with Scratch(spark, "fit", numbers=True) as s:
        assert spark.conf.get(HASH_JOINS) == "64m"
        t, labels = crossed(spark, s)
        assert s.table(t) is t
        made, whole = [], Scratch._write
        monkeypatch.setattr(Scratch, "_write", lambda self, df, *a, **k: made.append(df.columns) or whole(self, df, *a, **k))
        _, report = solve.fit(t, labels, ["y"], s, solve.Options("lsmr"))
        assert report.first().accepted and made and not any("tid" in c for c in made)
        sizes = solve.component_tuples(t, labels.where("q = 0").selectExpr("l AS a", "component"))
        assert {r.component: r.n for r in sizes.collect()} == {0: t.count()}
    assert {k: spark.conf.get(k) for k in before} == before


def test_components_beyond_a_hierarchy_stay_in_a_task_by_a_fixed_preconditioner(spark):
    with Scratch(spark, "plain") as s:
        t, labels = crossed(spark, s)
        options = solve.Options(dense_most=0, task_tuples=20, table_hierarchy=20)
        _, report = solve.fit(t, labels, ["y"], s, options)
        assert report.first().routes == "map" and report.first().accepted and not report.first().global_fallback
        _, report = solve.fit(t, labels, ["y"], s, solve.Options(dense_most=0, task_tuples=0))
        assert report.first().routes == "distributed" and report.first().accepted
