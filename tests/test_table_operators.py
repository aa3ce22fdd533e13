"""Matching by rounds, pair plans with exact sums and refusals, component layouts, packs of small components."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators import candidates, components, encode, kernel, linear, transfer
from triweave.operators.pairs import PairPlan
from triweave.plans import solve
from triweave.plans.scratch import Scratch
from triweave.sources import fixtures


def tuples_of(spark, keys, w):
    return spark.createDataFrame([(i, *k, float(x)) for i, (k, x) in enumerate(zip(keys, w, strict=True))], "tid long, a int, b int, c int, w double")


def test_greedy_matching_equals_the_rule_on_random_graphs_and_chains(spark):
    rng = random.Random(4)
    frames = []
    for q, n, m in ((0, 30, 120), (1, 60, 90), (2, 12, 60)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        frames += [(q, a, b, rng.choice([0.25, 0.5, 0.5, 0.75, rng.random()])) for a, b in pairs]
    frames += [(3, i, i + 1, 0.1 + i / 100) for i in range(8)]  # each waits for the next
    frame = spark.createDataFrame(frames, "q int, l int, r int, affinity double")
    with Scratch(spark, "matching") as s:
        got = {(r.q, r.l, r.r) for r in candidates.greedy_matching(frame, s).collect()}
        want = {(q, *p) for q in range(4) for p in candidates.greedy_match(pd.DataFrame([f for f in frames if f[0] == q], columns=["q", "l", "r", "affinity"]))}
        assert got == want
        levels = spark.createDataFrame([(q, x) for q in range(3) for x in range(60)], "q int, l int")
        m = candidates.matching_map(frame.where("q < 3"), levels, s)
        transfer.validate_map(m)
        parents = {(r.q, r.l): r.parent for r in m.collect()}
        assert len(parents) == 180 and all(parents[q, a] == parents[q, b] for q, a, b in want if q < 3)
        assert candidates.greedy_matching(frame.where("false"), s).count() == 0


def test_pair_plan_replays_generations_exactly(spark):
    rng = random.Random(6)
    keys = sorted({(rng.randrange(4), rng.randrange(5), rng.randrange(6)) for _ in range(60)})
    with Scratch(spark, "pairs") as s:
        plan = PairPlan(s.table(tuples_of(spark, keys, [1] * len(keys))), s)
        for seed in (1, 2):
            rng = random.Random(seed)
            w = [rng.random() * 2.0 ** rng.randrange(-60, 60) for _ in keys]
            edges = plan.conductances(tuples_of(spark, keys, w))
            parts = {}
            for k, x in zip(keys, w, strict=True):
                for pair, i, j in (("12", 0, 1), ("13", 0, 2), ("23", 1, 2)):
                    parts.setdefault((pair, k[i], k[j]), []).append(x)
            want = {k: math.fsum(v) for k, v in parts.items()}
            rows = edges.collect()
            assert {(r.pair, r.u, r.v): r.w for r in rows} == want
            assert [(r.pair, r.u, r.v) for r in sorted(rows, key=lambda r: r.edge)] == sorted(want)
            ends = {}
            for (pair, u, v), x in want.items():
                ends.setdefault((pair, 0, u), []).append(x)
                ends.setdefault((pair, 1, v), []).append(x)
            assert {(r.pair, r.side, r.l): r.d for r in plan.degrees(edges).collect()} == {k: math.fsum(v) for k, v in ends.items()}


def test_sums_of_weights_are_rounded_once_and_overflow_is_refused(spark):
    with Scratch(spark, "exact") as s:
        keys = [(0, 0, 0), (0, 0, 1), (0, 0, 2)]
        t = s.table(tuples_of(spark, keys, [1e16, 1.0, 1.0]))
        plan = PairPlan(t, s)
        assert [r.w for r in plan.conductances(t).where("pair = '12'").collect()] == [1e16 + 2]
        doubled = t.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "w")
        assert encode.exact_collapse(doubled, "w").first()["w"] == 1e16 + 2
        ones = linear.edges(t).distinct().withColumn("x", F.when(F.col("q") == 0, 1.0).otherwise(0.0))
        assert linear.exact_energy(t, ones).first()["energy"] == 1e16 + 2
        merge = spark.createDataFrame([(i, 0) for i in range(3)], "tid long, ctid long")
        assert transfer.exact_replay(t, merge).first()["w"] == 1e16 + 2
        # degrees are of the conductances as represented: 2^53 - 1 and a half make 2^53, tie to even
        near = s.table(tuples_of(spark, [(0, 0, 0), (0, 0, 1), (0, 1, 0)], [2.0**53 - 1, 0.25, 0.5]))
        near_plan = PairPlan(near, s)
        edges = near_plan.conductances(near)
        assert {(r.u, r.v): r.w for r in edges.where("pair = '12'").collect()} == {(0, 0): 2.0**53 - 1, (0, 1): 0.5}
        assert near_plan.degrees(edges).where("pair = '12' AND side = 0").first()["d"] == 2.0**53
        large = t.withColumn("w", F.lit(1.5e308))
        with pytest.raises(ModelError, match="pair conductance"):
            plan.conductances(large)
        one_edge = s.table(tuples_of(spark, [(0, 0, 0), (0, 1, 1)], [1.5e308, 1.5e308]))
        edge_plan = PairPlan(one_edge, s)
        with pytest.raises(ModelError, match="pair weighted degree"):
            edge_plan.degrees(edge_plan.conductances(one_edge))
        tiny = s.table(tuples_of(spark, [(0, 0, 0)], [5e-324]))
        assert [r.w for r in PairPlan(tiny, s).conductances(tiny).collect()] == [5e-324] * 3


def test_component_layout_is_a_permutation(spark):
    with Scratch(spark, "layout") as s:
        t = s.table(tuples_of(spark, [(0, 3, 0), (1, 2, 1), (2, 3, 2), (3, 1, 1), (4, 0, 3)], [1] * 5))
        labels = components.component_labels(t, s)
        layout = components.ComponentLayout(labels, s)
        x = labels.select("q", "l", (F.col("q") * 10.0 + F.col("l")).alias("x"))
        gathered = layout.gather(x)
        assert sorted(r.position for r in gathered.collect()) == list(range(labels.count()))
        assert sorted(map(tuple, layout.scatter(gathered.select("position", "x")).collect())) == sorted(map(tuple, x.collect()))
        ends = sorted((r.start, r.start + r.n) for r in layout.ranges().collect())
        assert [a for a, _ in ends[1:]] == [b for _, b in ends[:-1]] and ends[0][0] == 0
        for r in layout.ranges().collect():
            assert {g.component for g in gathered.where(F.col("position").between(r.start, r.start + r.n - 1)).collect()} == {r.component}


def test_many_small_components_go_in_packs(spark, monkeypatch):
    monkeypatch.setattr(solve, "PACK", 40)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(150):
        n = int(rng.choice([1, 2, 2, 3, 5, 30]))
        for k in np.unique(rng.integers(0, 3, (n, 3)), axis=0):
            rows.append((*(int(x) + 3 * c for x in k), float(rng.integers(1, 5)), float(rng.standard_normal()), float(rng.standard_normal())))
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tid long, a int, b int, c int, w double, y double, y2 double")
    with Scratch(spark, "packs") as s:
        t = s.table(t)
        labels = s.table(components.component_labels(t, s))
        coefficients, report = solve.fit(t, labels, ["y", "y2"], s)
        report = report.collect()
        assert all(r.accepted and not r.global_fallback and r.routes == "dense,singleton" for r in report)
        m = np.array(rows)
        b = np.column_stack([(m[:, q][:, None] == np.unique(m[:, q])[None]).astype(float) for q in range(3)])
        root = np.sqrt(m[:, 3])[:, None]
        want = b @ np.linalg.lstsq(b * root, m[:, 4:] * root, rcond=None)[0]
        for k in range(2):
            got = {r.tid: r.fitted for r in solve.fitted_values(t, coefficients, k).collect()}
            assert np.allclose([got[i] for i in range(len(rows))], want[:, k])


def test_rank_and_nullity_by_peeling_equal_dense_ranks(spark):
    rng = np.random.default_rng(3)
    keys = [np.array(fixtures.latin_square(3)[0]), np.array(fixtures.nested_third(4)[0]) + 10, np.array(fixtures.weak_chain(6, 1.0)[0]) + 20]
    keys += [np.unique(rng.integers(0, 4, (n, 3)), axis=0) + 30 + 10 * i for i, n in enumerate((3, 7, 14))] + [np.array([[99, 99, 99]])]
    keys = np.concatenate(keys)
    with Scratch(spark, "kernel") as s:
        t = s.table(tuples_of(spark, [tuple(map(int, k)) for k in keys], [1.0] * len(keys)))
        labels = s.table(components.component_labels(t, s))
        of = {(r.q, r.l): r.component for r in labels.collect()}
        want = {}
        for c in set(of.values()):
            own = np.array([k for k in keys if of[0, int(k[0])] == c])
            b = np.column_stack([(own[:, q][:, None] == np.unique(own[:, q])[None]).astype(float) for q in range(3)])
            rank = int(np.linalg.matrix_rank(b))
            want[c] = (rank, b.shape[1] - rank, b.shape[1] - rank == 2)
        got = {r.component: (r.rank, r.nullity, r.structural) for r in kernel.rank_nullity(t, labels, s).collect()}
        assert got == want and any(n > 2 for _, n, _ in want.values())  # additional nullity among them
        core, gone = kernel.peeled(t.join(labels.where("q = 0").select(F.col("l").alias("a"), "component"), "a"), s)
        assert core.count() + gone.count() == len(keys) and core.count() > 0
        with pytest.raises(ModelError, match="core too large"):
            kernel.rank_nullity(t, labels, s, core=3)
