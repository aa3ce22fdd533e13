"""Tuples packed in blocks: products equal the plain ones, no block moves, and conjugate gradients on them write no tuple."""

import numpy as np
from pyspark.sql import functions as F

from triweave.operators import columns, components
from triweave.operators.blocks import Blocks
from triweave.operators.columns import Columns, level_counts
from triweave.plans import batch
from triweave.plans.scratch import Scratch


def test_blocks_multiply_as_joins_do_and_stay_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(3)
    part = rng.integers(0, 3, 500)  # three components, each with a level of the largest factor that has half of the tuples
    keys = np.column_stack((part * 9 + rng.integers(0, 9, 500), part * 40 + np.where(rng.integers(0, 2, 500) == 1, 0, rng.integers(0, 40, 500)), part * 6 + rng.integers(0, 6, 500)))
    keys = np.unique(keys, axis=0)
    keys = np.column_stack([np.unique(keys[:, q], return_inverse=True)[1] for q in range(3)])
    with Scratch(spark, "blocks", numbers=True) as s:
        t = s.table(spark.createDataFrame([(i, *map(int, k), float(1 + i % 5), float(i % 7)) for i, k in enumerate(keys)], "tid long, a int, b int, c int, w double, y double"))
        labels = s.table(components.component_labels(t, s))
        x = s.table(labels.select("q", "l", F.array((F.col("l") % 7 - 3).cast("double"), (F.col("l") % 5 + 0.5).cast("double")).alias("x")))
        blocks = Blocks(t, labels, 2, s, level_counts(labels), block=40)
        sizes = [len(np.frombuffer(r.w)) for r in blocks.blocks.select("w").collect()]
        assert sum(sizes) == len(keys) and max(sizes) < 80
        of = lambda rows: {(r.q, r.l): r.x for r in rows.collect()}
        got, want = of(blocks.gramian(x)), of(Columns(t, 2, s).gramian(x))
        assert got.keys() == want.keys() and all(np.allclose(got[v], want[v]) for v in want)
        plan = blocks.gramian(x)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # cells of levels, and the sums by level
        names = list(blocks.names)
        blocks.close()
        assert names and not any(spark.catalog.tableExists(name) for name in names)
        monkeypatch.setattr(columns, "BROADCAST_BYTES", 0)
        run = batch.pcg(t, labels, ["y"], s, rel=1e-11, most=60)
        assert run.converged == [True] and batch.certificates(t, run.coefficients, ["y"], s)[0] < 1e-9
