"""Numpy kernels against dense algebra."""

from itertools import combinations

import numpy as np
import pytest

from triweave.local import actions, coarsening, kernel, solvers
from triweave.local.dense import Pseudoinverse, spectrum
from triweave.local.problem import Local, coarse_index
from triweave.model import ModelError
from triweave.sources import fixtures


def rows(p):
    return np.eye(p.dim)[p.index].sum(axis=1)


def random_problem(seed=0, n=(12, 9, 7), e=150):
    rng = np.random.default_rng(seed)
    return Local.from_observations(np.column_stack([rng.integers(0, k, e) for k in n]), rng.integers(1, 9, e).astype(float))


def test_repeated_tuples_collapse():
    keys = np.array([(2, 0, 1), (0, 1, 0), (2, 0, 1), (1, 1, 1), (0, 1, 0), (2, 0, 1)])
    p = Local.from_observations(keys, 2.0 ** np.arange(6))
    assert p.keys.tolist() == [[0, 1, 0], [1, 1, 1], [2, 0, 1]] and p.w.tolist() == [18, 8, 37]
    b = rows(p)
    np.testing.assert_allclose(p.dense(), b.T @ np.diag(p.w) @ b)


def test_every_small_support():
    grid = [(i, j, k) for i in range(2) for j in range(2) for k in range(2)]
    for r in range(1, 6):
        for chosen in combinations(grid, r):
            codes = np.column_stack([np.unique([t[q] for t in chosen], return_inverse=True)[1] for q in range(3)])
            p = Local(codes, np.arange(1.0, r + 1))
            b, x, y = rows(p), np.arange(p.dim) - 1.0, np.arange(r) + 0.5
            np.testing.assert_allclose(p.b(x), b @ x)
            np.testing.assert_allclose(p.bt(y), b.T @ y)
            assert abs(p.energy(x) - x @ p.dense() @ x) < 1e-9
            rank = np.linalg.matrix_rank(b)
            assert sum(c["rank"] for c in kernel.kernel_certificate(p)) == rank == Pseudoinverse(p.dense()).rank
            z = p.project(x)
            np.testing.assert_allclose(p.b(z), p.b(x), atol=1e-12)
            np.testing.assert_allclose(p.project(z), z, atol=1e-12)


def test_galerkin():
    p = random_problem()
    parent = coarsening.consecutive(p)
    at = coarse_index(parent, p.sizes)
    m = np.eye(at.max() + 1)[at]
    np.testing.assert_allclose(p.coarsen(parent).dense(), m.T @ p.dense() @ m)


@pytest.mark.parametrize("name", ["identity", "diagonal", "map", "schwarz", "hierarchy", "hybrid", "two_grid", "sum"])
def test_solvers_reach_least_squares(name):
    p = random_problem()
    coarse = actions.coarse_correction(p, coarsening.consecutive(p))
    action = {
        "identity": lambda: actions.projected(p, actions.identity(p)),
        "diagonal": lambda: actions.diagonal(p),
        "map": lambda: actions.symmetric_map(p),
        "schwarz": lambda: actions.pair_schwarz(p),
        "hierarchy": lambda: actions.Hierarchy(p, coarsening.hierarchy_maps(p, terminal=16)),
        "hybrid": lambda: actions.hybrid(p, actions.symmetric_map(p), coarse),
        "two_grid": lambda: actions.two_grid(p, actions.jacobi(p), coarse),
        "sum": lambda: actions.weighted_sum(actions.diagonal(p), actions.pair_schwarz(p), 0.5, 1.0),
    }[name]()
    y = np.random.default_rng(3).standard_normal(len(p.w))
    exact = p.b(np.linalg.lstsq(p.root_w[:, None] * rows(p), p.root_w * y, rcond=None)[0])
    one = solvers.pcg(p, p.rhs(y), action, 1e-11, traced=True)
    two, certificate = solvers.gated_lsmr(p, y, action, 1e-11)
    assert one.converged and np.abs(p.b(one.x) - exact).max() < 1e-8
    assert certificate < 1e-9 and np.abs(p.b(two.x) - exact).max() < 1e-8
    s = spectrum(p.dense(), action)
    assert s["symmetry_defect"] < 1e-9 and s["negative_directions"] == 0 and s["leakage"] < 1e-9


def test_gate_vetoes_and_zero_rhs():
    p = random_problem()
    y = np.random.default_rng(1).standard_normal(len(p.w))
    loose = solvers.lsmr(p, y, actions.symmetric_map(p), 1e-2)
    gated, certificate = solvers.gated_lsmr(p, y, actions.symmetric_map(p), 1e-10)
    assert gated.iterations > loose.iterations and certificate <= 1e-10
    assert solvers.lsmr(p, 0 * y, actions.diagonal(p)).stop == "zero rhs" and solvers.pcg(p, 0 * p.diag, actions.diagonal(p)).stop == "zero rhs"
    assert p.certificate(0 * y, 0 * p.diag) == 0
    with pytest.raises(ModelError):
        p.certificate(0 * y, np.ones(p.dim))


def test_kernels_of_families():
    p = Local(*fixtures.nested_third(5))
    assert [c["nullity"] for c in kernel.kernel_certificate(p)] == [15 - Pseudoinverse(p.dense()).rank]
    q = Local(*fixtures.disconnected_latin(4))
    assert [(c["nullity"], c["structural"]) for c in kernel.kernel_certificate(q)] == [(2, True)] * 2
    x = kernel.range_projector(p)(np.arange(15.0))
    np.testing.assert_allclose(np.linalg.pinv(p.dense()) @ p.dense() @ x, x, atol=1e-9)


def test_weak_chain_needs_few_cycles():
    p = Local(*fixtures.weak_chain(40, 0.1))
    y = np.random.default_rng(0).standard_normal(len(p.w))
    slow = solvers.pcg(p, p.rhs(y), actions.diagonal(p), 1e-9, most=4000)
    h = coarsening.screened_hierarchy(p) or actions.Hierarchy(p, coarsening.hierarchy_maps(p, terminal=30))
    assert solvers.pcg(p, p.rhs(y), h, 1e-9).iterations < slow.iterations


def test_probe_tracks_radius_and_portfolio_accepts():
    p = random_problem()
    action = actions.symmetric_map(p)
    assert abs(coarsening.cycle_probe(p, action, steps=60) - spectrum(p.dense(), action)["stationary_radius"]) < 0.02
    parent, report = coarsening.portfolio(p)
    assert set(report) == {"learned", "neighborhood"} and (parent is None or len(parent) == p.dim)
    relax = coarsening.compatible_relaxation(p, coarsening.consecutive(p))
    assert 0 < relax["factor"] < 1 and relax["coarse_defect"] < 1e-8
    split = coarsening.split_repair(p, coarsening.consecutive(p), relax["witness"])
    assert coarse_index(split, p.sizes).max() >= coarse_index(coarsening.consecutive(p), p.sizes).max()


def test_matching_pairs_all_levels():
    p = Local(*fixtures.planted_clones(4, 2))
    parent = coarsening.match(p, coarsening.neighborhood_pairs(p))
    assert np.bincount(parent[:8]).tolist() == [2, 2, 2, 2]


def test_refusals():
    with pytest.raises(ModelError):
        Local(np.zeros((0, 3)), np.zeros(0))
    with pytest.raises(ModelError):
        Local(np.array([(0, 0, 0)]), np.array([0.0]))
    with pytest.raises(ModelError):
        Local(np.array([(0, 0, 0)]), np.array([1.0]), (2, 1, 1))
    with pytest.raises(ModelError):
        actions.jacobi(random_problem(), 0.7)
    with pytest.raises(ModelError):
        Pseudoinverse(np.diag([1.0, -1.0]))
