"""DataFrame operators, the registry and its SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from triweave.functions import ranks
from triweave.local.problem import Local
from triweave.model import Design, ModelError
from triweave.operators import components, encode, linear, smoothers, transfer
from triweave.operators.graph import connected_components
from triweave.plans import queries, solve
from triweave.plans.scratch import Scratch
from triweave.sources import binary, fixtures
from triweave.streaming.incremental import incremental_collapse

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["collapse_tuples", "canonical_tuples", "tuple_group_offsets", "weight_frame_observations", "gramian_apply", "residual", "dense_gramian_entries", "component_labels", "structural_projection", "kernel_rank_nullity", "galerkin_action", "coarse_weight_replay", "pair_signed_laplacian", "pair_components", "neighborhood_candidates", "adjacent_pair_candidates", "map_forward_sweep", "map_symmetric_sweep", "weighted_adjoint", "rhs_from_targets", "jacobi_action", "compatible_projection", "gramian_image", "hierarchy_weight_replay", "component_rhs", "fitted_balanced_automatic", "fitted_nested_distributed"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_registry_without_the_optional_subpackage():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ranks_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ONE_TASK_ROWS", 10)
    got = ranks.numbered(spark.range(5, 105), ["id"], "n").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, i - 5) for i in range(5, 105)]


def test_components_of_a_path_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (1, 0), (None, 3)]
    with Scratch(spark, "t") as s:
        got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), s).collect())
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 120)}}
    with Scratch(spark, "t") as s:
        assert connected_components(spark.createDataFrame([], "a long, b long"), s).count() == 0


def tuples_of(spark, keys, w, y=None):
    y = np.zeros(len(keys)) if y is None else y
    return spark.createDataFrame([(i, *map(int, k), float(a), float(b)) for i, (k, a, b) in enumerate(zip(keys, w, y, strict=True))], "tid long, a int, b int, c int, w double, y double")


def test_fit_on_fixtures_with_every_route(spark):
    rng = np.random.default_rng(0)
    for keys, w in (fixtures.disconnected_latin(3), fixtures.nested_third(4), (np.array([(0, 0, 0), (1, 1, 1)]), np.ones(2))):
        y = rng.standard_normal(len(w))
        p = Local(keys, w)
        exact = p.b(np.linalg.lstsq(p.root_w[:, None] * np.eye(p.dim)[p.index].sum(axis=1), p.root_w * y, rcond=None)[0])
        for options in (solve.Options(), solve.Options("lsmr"), solve.Options("pcg", "diagonal"), solve.Options(dense_most=0)):
            with Scratch(spark, "t") as s:
                t = s.table(tuples_of(spark, keys, w, y))
                coefficients, report = solve.fit(t, components.component_labels(t, s), ["y"], s, options)
                got = {r.tid: r.fitted for r in solve.fitted_values(t, coefficients).collect()}
                assert report.first().accepted
            np.testing.assert_allclose([got[i] for i in range(len(w))], exact, atol=1e-7)


def test_failed_columns_fall_back(spark):
    keys, w = fixtures.latin_square(4)
    with Scratch(spark, "t") as s:
        t = s.table(tuples_of(spark, keys, w, np.random.default_rng(0).standard_normal(len(w))))
        _, report = solve.fit(t, components.component_labels(t, s), ["y"], s, solve.Options("pcg", "diagonal", iterations=1), accept=1e-8)
        row = report.first()
        assert row.global_fallback


def test_singletons(spark):
    with Scratch(spark, "t") as s:
        t = s.table(tuples_of(spark, np.array([(0, 0, 0), (1, 1, 1), (1, 2, 1)]), np.ones(3), np.array([6.0, 1.0, 2.0])))
        got = solve.singleton_solution(t, components.component_labels(t, s), ["y"]).collect()
    assert [(r.q, r.l, r.x) for r in sorted(got)] == [(0, 0, 2.0), (1, 0, 2.0), (2, 0, 2.0)]


def test_refusals(spark):
    design = Design(("k1", "k2", "k3"))
    make = lambda *r: spark.createDataFrame(list(r), "row_id long, k1 string, k2 string, k3 string, w double, y double")
    for bad in ((0, "a", None, "c", 1.0, 1.0), (0, "a", "b", "c", 0.0, 1.0), (0, "a", "b", "c", float("nan"), 1.0), (0, "a", "b", "c", 1.0, float("inf"))):
        with pytest.raises(ModelError):
            encode.encode(make(bad), design, check=True)
    with pytest.raises(ModelError):
        encode.validate_observations(make(), design)
    t = tuples_of(spark, [(0, 0, 0), (0, 0, 0)], [1, 1])
    with pytest.raises(ModelError):
        encode.check_canonical(t)
    with pytest.raises(ModelError):
        encode.check_levels(tuples_of(spark, [(0, 0, 0), (2, 0, 0)], [1, 1]), (3, 1, 1))
    m = spark.createDataFrame([(0, 0, 0), (0, 1, 2)], "q int, l int, parent int")
    with pytest.raises(ModelError):
        transfer.validate_map(m)
    keys, w = fixtures.latin_square(4)
    with Scratch(spark, "hierarchy") as s:
        t = tuples_of(spark, keys, w)
        labels = linear.edges(t).distinct().withColumn("component", F.lit(0))
        h = transfer.Hierarchy(t, labels, s, max_levels=3, max_tuples=30)
        for bad, code in ((transfer.identity_map(labels), "no reduction"), (transfer.halving_map(labels).where("l > 0"), "level without aggregate"), (labels.select("q", "l", (2 * F.floor(F.col("l") / 2)).cast("int").alias("parent")), "empty aggregate")):
            with pytest.raises(ModelError, match=code):
                h.append(bad)
        h.append(transfer.halving_map(h.labels[-1]))
        h.append(transfer.halving_map(h.labels[-1]))
        assert h.tuple_complexity > 1 and len(h.levels) == 3 and h.sizes == [16, 8, 1]
        with pytest.raises(ModelError, match="too many levels"):
            h.append(transfer.halving_map(h.labels[-1]))
        frames = h.replay(h.levels[0])
        assert [[r.w for r in f.orderBy("tid").collect()] for f in frames] == [[r.w for r in x.orderBy("tid").collect()] for x in h.levels]
        assert h.provisional(frames[1]).collect() == frames[2].collect()
        with pytest.raises(ModelError, match="coarse tuple total"):
            h.provisional(frames[1].withColumn("w", F.lit(1.5e308)))
        two = labels.withColumn("component", F.col("l") % 2)
        with pytest.raises(ModelError, match="crosses components"):
            transfer.Hierarchy(t, two, s).append(transfer.halving_map(labels))


def test_binary_round_trip(spark, tmp_path):
    keys, w = fixtures.latin_square(3)
    y = np.arange(18.0).reshape(2, 9)
    for depth in (None, 4):
        (tmp_path / f"p{depth}.bin").write_bytes(binary.encode((3, 3, 3), keys, w, y, depth))
    got = binary.read_problems(spark, str(tmp_path)).collect()
    assert len(got) == 18 and sorted(r.ys for r in got)[0] == [0.0, 9.0]
    with pytest.raises(ModelError):
        binary.decode(b"nonsense" + bytes(24))


def test_incremental_collapse(spark, tmp_path):
    source = os.path.join(tmp_path, "in")
    spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 1, 3.0), (1, 2, 1, 1.0)], "a int, b int, c int, w double").write.parquet(source)
    stream = spark.readStream.schema("a int, b int, c int, w double").parquet(source)
    out = incremental_collapse(stream, ("a", "b", "c"), "w").writeStream.outputMode("complete").format("memory").queryName("collapsed").trigger(availableNow=True).option("checkpointLocation", os.path.join(tmp_path, "ck")).start()
    out.awaitTermination(60)
    assert sorted(map(tuple, spark.table("collapsed").collect())) == [(1, 1, 1, 5.0, 2), (1, 2, 1, 1.0, 1)]


def test_a_run_that_ends_at_its_limit_says_so(spark):
    rows = [(i, i % 7, i % 5, i % 3, 1.0 + i % 4, float((i * 37) % 11)) for i in range(60)]
    tuples = spark.createDataFrame(rows, "tid long, a long, b long, c long, w double, y double")
    levels = {(q, r[1 + q]) for r in rows for q in range(3)}
    labels = spark.createDataFrame([(q, x, 0) for q, x in sorted(levels)], "q int, l long, component long")
    with Scratch(spark, "limit") as s:
        assert solve.distributed_pcg(tuples, labels, "y", s, 1e-10, 1)[1:] == (1, False)
        x, iterations, met = solve.distributed_pcg(tuples, labels, "y", s, 1e-10, 100)
        assert met and 1 < iterations < 100
        x = s.table(x.withColumn("k", F.lit(0)))
        assert solve.certify(tuples, x, ["y"]).first().ratio < 1e-8
        short = x.where("NOT (q = 1 AND l = 2)")
        assert solve.certify(tuples, short, ["y"]).first().ratio is None
        assert linear.normal_equation_certificate(tuples, short).first().ratio is None


def test_jacobi_refuses_relaxation_that_may_diverge(spark):
    t = spark.createDataFrame([(0, 0, 0, 0, 2.0)], "tid long, a int, b int, c int, w double")
    r = spark.createDataFrame([(0, 0, 1.0), (1, 0, -1.0), (2, 0, 4.0)], "q int, l int, x double")
    assert sorted(map(tuple, smoothers.jacobi(t, r).collect())) == [(0, 0, 0.25), (1, 0, -0.25), (2, 0, 1.0)]
    for omega in (0.0, 2 / 3, -1.0):
        with pytest.raises(ModelError):
            smoothers.jacobi(t, r, omega)
