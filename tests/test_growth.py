"""What a table of many rows moves: plans that shuffle no more than the work needs."""

import pytest
from pyspark.sql import functions as F

from triweave.functions import ranks
from triweave.operators import encode as enc
from triweave.plans import queries
from triweave.plans.queries import DESIGN, Loaded


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def obs(spark):
    return spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") * 7 % 300).alias("k1"), (F.col("id") * 11 % 97).alias("k2"), (F.col("id") % 20).alias("k3"), F.lit(2.0).alias("w"), F.lit(1.0).alias("w2"), F.col("id").cast("double").alias("y"))


def test_numbers_of_many_rows_need_no_second_shuffle(spark, monkeypatch):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"), "id")
    few = {r.k: r.n for r in ranks.numbered(rows, ["k"], "n", 5000).collect()}
    monkeypatch.setattr(ranks, "ONE_TASK_ROWS", 500)
    many = ranks.numbered(rows, ["k"], "n", 5000)
    assert "Exchange" not in _plan(many) and "Join" not in _plan(many)
    assert {r.k: r.n for r in many.collect()} == few


def test_levels_of_many_tuples_come_from_the_dictionaries(spark, obs, monkeypatch):
    few = Loaded(spark, obs, 3000)
    want = {(r.q, r.l) for r in few.levels(few.tuples).collect()}
    for module in (ranks, enc, queries):
        monkeypatch.setattr(module, "ONE_TASK_ROWS", 500)
    d = Loaded(spark, obs.select(*DESIGN.factors, "w"), 3000)
    t = d.tuples
    assert t.columns == ["a", "b", "c", "w", "tid"]
    assert sorted(map(tuple, t.collect())) == sorted((r.a, r.b, r.c, r.w, r.tid) for r in few.tuples.collect())
    levels = d.levels(t)
    assert "Exchange" not in _plan(levels)
    assert {(r.q, r.l) for r in levels.collect()} == want and levels.count() == len(want)


def test_packed_digits_are_the_same_sums_in_fewer_rows(spark):
    from triweave.operators.exact import added, digit_sums, packed_sums

    rows = spark.createDataFrame([(i % 5, v) for i, v in enumerate([0.1, -3.5, 1e300, 0.0, 2.0**40 + 0.5, None, float("nan"), -1e-310, 7.0, 7.0, float("inf"), 1e16, -1e16, 5.0] * 9)], "g int, x double")
    values = {"x": F.col("x"), "y": F.col("x") * 3}
    packed = packed_sums(rows, ["g"], values)
    rows_of = lambda df: sorted(map(tuple, df.where("part <> 0").select("g", "v", "bin", "part").collect()))
    assert rows_of(added(packed, ["g"])) == rows_of(digit_sums(rows, ["g"], values))
    plan = _plan(packed)
    assert plan.index("Generate") < plan.index("Exchange")  # digits become rows after the shuffle (plans read from the top)


def test_ledger_deals_its_sums_once(spark, tmp_path, monkeypatch):
    from jobs import tuple_ledger
    from triweave.plans.scratch import Scratch

    config, made = tuple_ledger.read_config(), []
    whole = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: made.append(_plan(df)) or whole(self, df))
    rows = spark.range(200).select((F.col("id") % 9).alias("l_suppkey"), F.lit("A").alias("l_returnflag"), F.lit("1995-03-04 00:00:00").cast("timestamp").alias("l_shipdate"), F.lit(2.0).alias("l_quantity"), F.col("id").cast("double").alias("l_extendedprice"), F.lit(0.5).alias("l_discount"))
    rows.write.parquet(f"{tmp_path}/in")
    tuple_ledger.update_ledger(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    sums = next(p for p in made if "collect_list" in p)
    assert sums.count("Exchange hashpartitioning") == 1


def test_hierarchy_of_a_neighbour_with_very_many_levels():
    import numpy as np

    from triweave.local.actions import symmetric_map
    from triweave.local.coarsening import hierarchy_maps, match, neighborhood_pairs, paired_rest, screened_hierarchy
    from triweave.local.problem import Local
    from triweave.local.solvers import gated_lsmr

    rng = np.random.default_rng(4)
    supplier = np.repeat(np.arange(3000), 25)
    keys = np.column_stack((supplier, supplier * 7 % 25, np.tile(np.arange(25), 3000)))
    p = Local(keys, rng.integers(1, 200, len(keys)).astype(float))
    parent = match(p, neighborhood_pairs(p))
    assert p.coarsen(parent).dim > 0.75 * p.dim  # the heaviest levels alone are too few
    full = paired_rest(p, parent)
    assert p.coarsen(full).dim <= 0.52 * p.dim
    for group in (np.flatnonzero(full[:3000] == g) for g in range(full[:3000].max() + 1)):
        assert len(group) <= 2 and (len(group) < 2 or p.components[group[0]] == p.components[group[1]])
    assert hierarchy_maps(p) is not None
    h = screened_hierarchy(p)
    assert h is not None and h.levels[-1].dim <= 256
    y = rng.normal(size=len(keys))
    got, certificate = gated_lsmr(p, y, h, 1e-10)
    other, _ = gated_lsmr(p, y, symmetric_map(p), 1e-10)
    assert certificate <= 1e-10 and np.allclose(p.b(got.x), p.b(other.x), atol=1e-6)


def test_components_are_found_among_the_fewest_levels(spark, monkeypatch):
    import numpy as np

    from triweave.local.problem import Local
    from triweave.operators import components as comp
    from triweave.plans.scratch import Scratch

    rng, seen = np.random.default_rng(6), []
    part = rng.integers(0, 12, 400)  # components that share no level, some of them joined only through later factors
    keys = np.unique(np.column_stack((part * 9 + rng.integers(0, 9, 400), part * 5 + rng.integers(0, 5, 400), part * 2 + rng.integers(0, 2, 400))), axis=0)
    codes = [np.unique(keys[:, q], return_inverse=True)[1] for q in range(3)]
    whole = comp.connected_components
    monkeypatch.setattr(comp, "connected_components", lambda edges, s: seen.append(edges) or whole(edges, s))
    with Scratch(spark, "labels") as s:
        for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):  # the factor with the fewest levels in each place
            p = Local(np.column_stack([codes[q] for q in order]), np.ones(len(keys)))
            tuples = s.table(spark.createDataFrame([(i, *map(int, k)) for i, k in enumerate(p.keys)], "tid long, a int, b int, c int"))
            got = {(r.q, r.l): r.component for r in comp.component_labels(tuples, s).collect()}
            assert got == {(q, l): int(p.components[p.offsets[q] + l]) for q in range(3) for l in range(p.sizes[q])}
            nodes = {v for r in seen[-1].collect() for v in r}
            assert len(nodes) <= min(p.sizes)


def test_lsmr_on_tables_writes_no_tuple(spark, monkeypatch):
    import numpy as np

    from triweave.operators import components as comp
    from triweave.plans import batch
    from triweave.plans.scratch import Scratch

    rng = np.random.default_rng(8)
    keys = np.unique(np.column_stack([rng.integers(0, n, 60) for n in (6, 5, 4)]), axis=0)
    keys = np.column_stack([np.unique(keys[:, q], return_inverse=True)[1] for q in range(3)])
    rows = [(i, *map(int, k), float(1 + i % 3), float(i % 7)) for i, k in enumerate(keys)]
    with Scratch(spark, "lsmr") as s:
        tuples = s.table(spark.createDataFrame(rows, "tid long, a int, b int, c int, w double, y double"))
        labels, made = s.table(comp.component_labels(tuples, s)), []
        whole = Scratch.table
        monkeypatch.setattr(Scratch, "table", lambda self, df: made.append(df.columns) or whole(self, df))
        run = batch.lsmr(tuples, labels, ["y"], s, tol=1e-11, certificate=1e-10, most=40)
        assert run.converged == [True] and made and not any("tid" in c for c in made)


def test_many_distinct_rows_are_dealt_once_for_sums_and_numbers(spark, obs, monkeypatch):
    want = sorted((r.a, r.b, r.c, r.w, r.tid) for r in Loaded(spark, obs, 3000).tuples.collect())
    for module in (ranks, enc, queries):
        monkeypatch.setattr(module, "ONE_TASK_ROWS", 500)
    dealt = []
    whole = queries.enc.canonical_tuples
    monkeypatch.setattr(queries.enc, "canonical_tuples", lambda rows, *a, **k: dealt.append(_plan(rows)) or whole(rows, *a, **k))
    twice = obs.unionByName(obs).withColumn("w", F.lit(1.0))  # each tuple twice or more: summed before the shuffle
    for rows, exchange in ((obs, "rangepartitioning"), (twice.unionByName(twice), "hashpartitioning")):
        t = Loaded(spark, rows.select(*DESIGN.factors, "w"), 3000).tuples
        assert dealt[-1].count("Exchange") - dealt[-1].count("BroadcastExchange") == 1 and f"Exchange {exchange}" in dealt[-1]
        got = sorted((r.a, r.b, r.c, r.w, r.tid) for r in t.collect())
        assert [g[:3] + g[4:] for g in got] == [g[:3] + g[4:] for g in want]
        assert sum(g[3] for g in got) == rows.agg(F.sum("w")).first()[0]


def test_composed_maps_and_marginals_of_repeated_rows(spark):
    from triweave.operators import pairs, transfer

    rows = spark.range(500).select((F.col("id") % 9).cast("int").alias("a"), (F.col("id") * 5 % 14).cast("int").alias("b"), (F.col("id") * 3 % 11).cast("int").alias("c"), (F.col("id") % 4 + 1.0).alias("w"))
    rows = rows.unionByName(rows)
    tuples = rows.groupBy("a", "b", "c").agg(F.sum("w").alias("w"))
    of = lambda df: sorted(map(tuple, df.collect()))
    assert of(pairs.pair_marginals(rows)) == of(pairs.pair_marginals(tuples))
    assert {r.pair for r in pairs.pair_marginals(rows).collect()} == {"12", "13", "23"}
    levels = tuples.select(F.posexplode(F.array("a", "b", "c")).alias("q", "l")).distinct()
    m = transfer.halving_map(levels)
    n = transfer.halving_map(m.select("q", F.col("parent").alias("l")).distinct())
    once = transfer.coarsen(rows, transfer.composed(m, n))
    assert _plan(once).count("Exchange hashpartitioning(p") <= 1
    assert of(once) == of(transfer.coarsen(transfer.coarsen(tuples, m), n))
