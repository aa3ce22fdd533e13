"""The V-cycle on tables: symmetric, equal to its matrix form, and fewer steps than the diagonal on a weak chain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators import components, linear, transfer
from triweave.operators.columns import Columns
from triweave.plans import batch, screening, solve
from triweave.plans.multilevel import VCycle, terminal_map
from triweave.plans.scratch import Scratch
from triweave.sources import fixtures


def chain(spark, s, n, bridge):
    keys, w = fixtures.weak_chain(n, bridge)
    order = np.lexsort(keys.T[::-1])
    rows = [(i, *map(int, keys[j]), float(w[j]), float((i * 37) % 11), float((i * i) % 7)) for i, j in enumerate(order)]
    t = s.table(spark.createDataFrame(rows, "tid long, a int, b int, c int, w double, y0 double, y1 double"))
    return t, s.table(components.component_labels(t, s))


def test_v_cycle_is_the_symmetric_matrix_and_saves_steps(spark):
    with Scratch(spark, "v-cycle") as s:
        t, labels = chain(spark, s, 8, 1e-3)
        h = transfer.Hierarchy(t, labels, s)
        h.append(transfer.halving_map(labels))
        index = [(r.q, r.l) for r in labels.orderBy("q", "l").collect()]
        n = len(index)
        g = np.zeros((n, n))
        for r in linear.gramian_entries(t).collect():
            g[index.index((r.q1, r.l1)), index.index((r.q2, r.l2))] = r.g
        p = np.zeros((n, n // 2))
        for i, (q, x) in enumerate(index):
            p[i, q * 4 + x // 2] = 1
        smooth = np.diag(0.5 / np.diag(g))
        first = smooth + p @ np.linalg.pinv(p.T @ g @ p, rcond=1e-12) @ p.T @ (np.eye(n) - g @ smooth)
        want = first + smooth @ (np.eye(n) - g @ first)
        rng = np.random.default_rng(1)
        r = rng.standard_normal((n, 2))
        frame = spark.createDataFrame([(q, x, [float(v) for v in row]) for (q, x), row in zip(index, r, strict=True)], "q int, l int, x array<double>")
        with VCycle(h, 2, s) as cycle:
            got = {(row.q, row.l): row.x for row in cycle(frame).collect()}
            got = np.array([got[v] for v in index])
            assert np.allclose(got, want @ r, atol=1e-8) and abs(got[:, 0] @ r[:, 1] - got[:, 1] @ r[:, 0]) < 1e-8
            names = ["y0", "y1"]
            plain = batch.pcg(t, labels, names, s, rel=1e-7, most=60)
            fast = batch.pcg(t, labels, names, s, kind=cycle, rel=1e-7, most=60)
        assert all(fast.converged) and max(fast.iterations) < min(plain.iterations)
        assert (batch.certificates(t, fast.coefficients, names, s) <= 1e-6).all()
        op = Columns(t, 2, s)
        one, two = ({row.tid: row.bx for row in op.image(x.coefficients).collect()} for x in (plain, fast))
        assert all(np.allclose(one[i], two[i], atol=1e-3) for i in one)
        with pytest.raises(ModelError, match="terminal"):
            VCycle(h, 2, s, terminal=4)


def local_of(keys, w):
    from triweave.local.problem import Local

    return Local(keys, w)


def test_relaxation_repair_and_probe_equal_their_matrix_forms(spark):
    with Scratch(spark, "screening") as s:
        keys, w = fixtures.weak_chain(4, 1e-3)
        t, labels = chain(spark, s, 4, 1e-3)
        p = local_of(keys, w)
        index = [(q, x) for q in range(3) for x in range(4)]
        over = labels.select("q", "l", F.lit(0).alias("parent"))  # all levels of a factor, weakly linked, in one aggregate
        at = np.array([q for q, _ in index])
        starts = {(r.q, r.l): r.x for r in screening.start_vectors(over, 2, 2).collect()}
        x = np.array([starts[v] for v in index])
        assert (np.abs(x) <= 1).all() and len(np.unique(x)) == x.size
        mass = np.bincount(at, p.diag)
        off = lambda v: v - np.column_stack([np.bincount(at, p.diag * c) / mass for c in v.T])[at]
        size = lambda v: np.sqrt((p.diag[:, None] * v * v).sum(axis=0))
        v = off(x)
        before = size(v)
        for _ in range(3):
            v = off(v - 0.5 * np.column_stack([p.g(c) for c in v.T]) / p.diag[:, None])
        relaxed = screening.compatible_relaxation(t, over, s, vectors=2, sweeps=3)
        assert np.allclose(relaxed.factors, (size(v) / before) ** (1 / 3)) and relaxed.coarse_defect < 1e-9
        witness = {(r.q, r.l): r.x for r in relaxed.witness.collect()}
        worst = int(np.argmax(relaxed.factors))
        assert np.allclose([witness[i] for i in index], v[:, worst])
        # the aggregates are too large; splits of the slowest one make the map acceptable
        assert not relaxed.accepted()
        d, m, splits = linear.degrees(t), over, 0
        while not relaxed.accepted() and splits < 9:
            mean = {q: sum(p.diag[i] * v[i, worst] for i in range(12) if at[i] == q) / mass[q] for q in range(3)} if not splits else None
            m = s.table(screening.split_repair(m, relaxed.witness, d))
            splits += 1
            if mean:  # the first split by hand: most D-energy, then the largest gap
                energy = [sum(p.diag[i] * (v[i, worst] - mean[q]) ** 2 for i in range(12) if at[i] == q) for q in range(3)]
                q = int(np.argmax(energy))
                order = sorted(range(4), key=lambda x: (v[q * 4 + x, worst], x))
                cut = int(np.argmax(np.diff([v[q * 4 + x, worst] for x in order]))) + 1
                assert {(r.q, r.l): r.parent for r in m.collect()} == {(f, x): int(f == q and x in order[cut:]) for f, x in index}
            relaxed = screening.compatible_relaxation(t, m, s, vectors=2, sweeps=3)
        assert relaxed.accepted() and m.select("q", "parent").distinct().count() == 3 + splits
        transfer.validate_map(m)
        # I - MG with Jacobi: the probe's factor is near the largest eigenvalue's size on the range
        with Columns(t, 3, s) as op:
            got = screening.cycle_probe(t, labels, screening.jacobi(op, s.table(d)), s, starts=3, steps=8)
        g = p.dense()
        root = np.diag(1 / np.sqrt(np.diag(g)))
        values = np.linalg.eigvalsh(0.5 * root @ g @ root)
        assert 0.8 * np.abs(1 - values[values > 1e-9]).max() <= got <= 1.0


def test_plans_stop_for_a_reason(spark):
    with Scratch(spark, "plans") as s:
        keys, w = fixtures.planted_clones(3, 4)
        order = np.lexsort(keys.T[::-1])
        t = s.table(spark.createDataFrame([(i, *map(int, keys[j]), float(w[j])) for i, j in enumerate(order)], "tid long, a int, b int, c int, w double"))
        labels = s.table(components.component_labels(t, s))
        plan = screening.plan_hierarchy(t, labels, s, terminal=20)
        assert plan.stop == "terminal reached" and plan.trials[0]["accepted"] and plan.trials[0]["factor"] <= screening.FACTOR
        assert len(plan.hierarchy.levels) == len(plan.trials) + 1
        total = [x.agg(F.sum("w")).first()[0] for x in plan.hierarchy.levels]
        assert np.allclose(total, total[0])
        assert screening.plan_hierarchy(t, labels, s, terminal=64).stop == "terminal reached"
        strict = screening.plan_hierarchy(t, labels, s, terminal=20, factor=0.01, repairs=0)
        assert strict.stop == "compatible gate" and len(strict.hierarchy.levels) == 1


def test_learned_scores_equal_the_rule_for_the_same_vectors(spark):
    from triweave.local import coarsening
    from triweave.operators import candidates

    with Scratch(spark, "learned") as s:
        keys, w = fixtures.nearly_nested(4, 0.25)
        order = np.lexsort(keys.T[::-1])
        t = s.table(spark.createDataFrame([(i, *map(int, keys[j]), float(w[j])) for i, j in enumerate(order)], "tid long, a int, b int, c int, w double"))
        labels = s.table(components.component_labels(t, s))
        p = local_of(keys, w)
        x = screening.test_vectors(t, labels, s, k=3, sweeps=3)
        got = {(r.q, r.l): r.x for r in x.collect()}
        vectors = np.array([got[q, i] for q in range(3) for i in range(4)])
        assert np.allclose((p.diag[:, None] * vectors**2).sum(axis=0), 1)
        assert np.allclose([p.project(v) for v in vectors.T], vectors.T)
        near = candidates.signature_pairs(x, labels, 3, s)
        scores = candidates.learned_scores(candidates.neighborhood_candidates(t), near, x, linear.degrees(t), 3)
        got = {(r.q, r.l, r.r): r.affinity for r in scores.collect()}
        want = {(q, a, b): v for q, a, b, v in coarsening.bootstrap_pairs(p, list(vectors.T))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        m, relaxed = screening.learned_map(t, labels, s, rounds=2, factor=0.01, k=2)
        transfer.validate_map(m, labels)
        assert 0 <= relaxed.factor < 1 and m.select("q", "parent").distinct().count() < 12


def two_small_factors(spark, s, parts=2, large=300):
    """``parts`` components of 3 and 4 levels beside ``large`` ones, most of whose weight lies with one level of the second factor."""
    rng = np.random.default_rng(5)
    keys = np.unique(np.array([(3 * p + rng.integers(3), 4 * p + (i % 4 if rng.integers(4) else rng.integers(4)), large * p + i) for p in range(parts) for i in range(large) for _ in range(5)]), axis=0)
    w = rng.integers(1, 9, len(keys)).astype(float)
    y = rng.standard_normal(len(keys)) * 100
    t = s.table(spark.createDataFrame([(i, *map(int, k), float(v), float(z)) for i, (k, v, z) in enumerate(zip(keys, w, y, strict=True))], "tid long, a int, b int, c int, w double, y double"))
    return t, s.table(components.component_labels(t, s)), keys, w, y


def test_components_beyond_a_task_go_by_a_hierarchy_on_tables(spark):
    with Scratch(spark, "beyond") as s:
        t, labels, keys, w, y = two_small_factors(spark, s)
        m = terminal_map(t, labels, s)
        transfer.validate_map(m, labels)
        parent = {(r.q, r.l): r.parent for r in m.collect()}
        counts = [len({v for (q, _), v in parent.items() if q == f}) for f in range(3)]
        assert len(parent) == labels.count() and counts[:2] == [6, 8] and 200 < sum(counts) <= 256
        sizes = np.bincount([v for (q, _), v in parent.items() if q == 2])
        assert sizes.max() <= sizes.min() + 1
        assert terminal_map(t, labels, s, terminal=20) is None  # the small factors alone are over half of it
        assert terminal_map(t, labels, s, terminal=labels.count()) is None  # nothing to merge
        options = solve.Options(task_tuples=100, table_hierarchy=100)
        coefficients, report = solve.fit(t, labels, ["y"], s, options)
        made = report.first()
        assert made.routes == "hierarchy" and made.accepted and not made.global_fallback
        b = np.zeros((len(keys), sum(keys.max(axis=0) + 1)))
        for q, at in enumerate(np.cumsum([0, *(keys.max(axis=0) + 1)])[:3]):
            b[np.arange(len(keys)), at + keys[:, q]] = 1
        want = b @ np.linalg.lstsq(b * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        got = {r.tid: r.fitted for r in solve.fitted_values(t, coefficients).collect()}
        assert np.allclose([got[i] for i in range(len(keys))], want, atol=1e-6)
