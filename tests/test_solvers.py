"""Solvers of one tile against exhaustive search and invariants."""

import itertools

import numpy as np
import pytest

from phasegrid.options import CostModel, LaplaceOptions
from phasegrid.solvers import network as N
from phasegrid.solvers import tiles as S

TWO_PI = 2 * np.pi


def noisy(shape, sigma, seed=0):
    r, c = np.indices(shape)
    return 0.3 * r + 0.4 * c + np.random.default_rng(seed).normal(0, sigma, shape)


def wrapped(x):
    return np.mod(x, TWO_PI)


def curl(k_row, k_col):
    return k_col[:-1] - k_row[:, 1:] - k_col[1:] + k_row[:, :-1]


def objective(flow, off, var, ns=200):
    return int(((flow * ns + off) ** 2 // var).sum())


def random_surface(rng, n=3):
    return wrapped(rng.uniform(0, 20, (n, n)))


def surfaces(psi):
    """The flows of every surface that is congruent with a 3 x 3 phase, up to two cycles each way."""
    return [S.flows_of(psi, psi + TWO_PI * np.array((0, *n)).reshape(3, 3)) for n in itertools.product(range(-2, 3), repeat=8)]


@pytest.mark.parametrize("seed", range(6))
def test_least_cost_flow_clears_residues(seed):
    psi = wrapped(noisy((9 + 7 * seed, 11 + 5 * seed), 1.5, seed))
    net = N.Network(*psi.shape)
    weight = np.random.default_rng(seed).integers(1, 50, net.n_arcs)
    flow = N.least_cost_flow(net, S.residue_supply(psi), N.LinearCost(weight))
    assert (curl(*net.planes(flow)).ravel() == -S.residue_supply(psi)).all()
    assert (N.cancel_cycles(net, flow, N.LinearCost(weight)) == flow).all() or weight @ np.abs(N.cancel_cycles(net, flow, N.LinearCost(weight))) == weight @ np.abs(flow)


@pytest.mark.parametrize("seed", range(4))
def test_least_cost_flow_is_optimal_on_a_small_grid(seed):
    rng = np.random.default_rng(seed)
    psi = random_surface(rng)
    net = N.Network(3, 3)
    every = surfaces(psi)
    linear = N.LinearCost(rng.integers(1, 20, net.n_arcs))
    smooth = N.SmoothCost(rng.integers(-300, 300, net.n_arcs), np.where(rng.random(net.n_arcs) < 0.2, 32000, rng.integers(20, 3000, net.n_arcs)), 200)
    for cost in (linear, smooth):
        flow = N.least_cost_flow(net, S.residue_supply(psi), cost)
        assert (curl(*net.planes(flow)).ravel() == -S.residue_supply(psi)).all()
        assert cost.at(flow).sum() <= min(cost.at(f).sum() for f in every)


@pytest.mark.parametrize("seed", range(4))
def test_paths_and_cycles_reach_the_same_cost(seed):
    """Two methods, the slow phases' tail included, on a raster with free arcs."""
    rng = np.random.default_rng(seed)
    psi = wrapped(noisy((40, 31), 2.0, seed))
    net = N.Network(*psi.shape)
    cost = N.SmoothCost(rng.integers(-150, 150, net.n_arcs), np.where(rng.random(net.n_arcs) < 0.3, 32000, rng.integers(1, 900, net.n_arcs)), 200)
    a = N.least_cost_flow(net, S.residue_supply(psi), cost)
    b = N.cancel_cycles(net, S.flows_of(psi, psi), cost)
    assert (net.excess(a) == net.excess(b)).all() and cost.at(a).sum() == cost.at(b).sum()


@pytest.mark.parametrize("seed", range(3))
def test_cancelling_reaches_the_exhaustive_optimum(seed):
    rng = np.random.default_rng(seed)
    psi = random_surface(rng)
    net = N.Network(3, 3)
    off, var = rng.integers(-99, 100, net.n_arcs), rng.integers(20, 3000, net.n_arcs)
    done = N.cancel_cycles(net, S.flows_of(psi, psi), N.SmoothCost(off, var, 200))
    assert objective(done, off, var) == min(objective(f, off, var) for f in surfaces(psi))
    assert (curl(*net.planes(done)).ravel() == -S.residue_supply(psi)).all()


def test_deformation_costs_have_a_shelf_and_longer_steps_cross_it():
    """From a flow that single units can't improve, more units at once do."""
    net = N.Network(2, 2)
    off, var = np.array([0, 0, 0, 0]), np.array([10, 10, 10, 10])
    cost = N.DefoCost(off, var, np.full(4, 1000), np.full(4, 500), 200)
    assert cost.at(np.array([0, 1, 4, 6])).tolist() == [0, 500, 500, 500 + 200 * 200 // 20]
    start = np.array([3, 3, -3, -3])
    start = start - 0
    assert (net.excess(start)[:-1] == 0).all()
    one, more = N.cancel_cycles(net, start, cost, 1), N.cancel_cycles(net, start, cost, 4)
    assert cost.at(one).sum() == cost.at(start).sum() and cost.at(more).sum() == 0


@pytest.mark.parametrize("seed", range(3))
def test_deformation_descent_never_rises(seed):
    rng = np.random.default_rng(seed)
    psi = wrapped(noisy((24, 20), 2.0, seed))
    net = N.Network(*psi.shape)
    cost = N.DefoCost(rng.integers(-99, 99, net.n_arcs), rng.integers(20, 900, net.n_arcs), np.full(net.n_arcs, 240), rng.integers(50, 400, net.n_arcs), 200)
    start = S.flows_of(psi, psi)
    done = N.improved_flow(net, start, cost, 4)
    assert (net.excess(done) == net.excess(start)).all() and cost.at(done).sum() < cost.at(start).sum()


def test_masked_loops_keep_their_flows():
    rng = np.random.default_rng(5)
    psi = wrapped(noisy((20, 20), 2.0, 5))
    magnitude = np.ones((20, 20))
    magnitude[5:12, 6:14] = 0
    net = N.Network(20, 20)
    closed = net.masked_arcs(magnitude)
    assert closed.sum() == 2 * 6 * 7 + 6 + 7
    cost = N.SmoothCost(rng.integers(-99, 99, net.n_arcs), rng.integers(20, 900, net.n_arcs), 200)
    start = S.flows_of(psi, psi)
    done = N.improved_flow(net, start, cost, 1, closed)
    assert (done[closed] == start[closed]).all() and cost.at(done).sum() < cost.at(start).sum()
    assert cost.at(N.improved_flow(net, start, cost)).sum() <= cost.at(done).sum()


def test_a_large_noisy_tile_is_solved():
    psi = wrapped(noisy((256, 256), 2.0, 1))
    net = N.Network(256, 256)
    off = np.concatenate([(-200 * S.wrap(np.diff(psi, axis=0)) / TWO_PI).ravel(), (200 * S.wrap(np.diff(psi, axis=1)) / TWO_PI).ravel()]).astype(int)
    flow = N.least_cost_flow(net, S.residue_supply(psi), N.SmoothCost(off, np.full(net.n_arcs, 60), 200))
    assert (net.excess(flow)[:-1] == -S.residue_supply(psi)).all()


def test_integration_inverts_seeding():
    u = noisy((12, 9), 2.0)
    psi = wrapped(u)
    net = N.Network(12, 9)
    back = S.integrate(psi, *net.planes(S.flows_of(psi, u)))
    assert np.allclose(back - back[0, 0], u - u[0, 0])


def test_tree_flow_is_congruent_and_recovers_a_ramp():
    r, c = np.indices((20, 25))
    u = 0.1 * r + 0.2 * c
    psi = wrapped(u)
    flow = S.tree_flow(psi, np.ones((19, 25)), np.ones((20, 24)))
    back = S.integrate(psi, *N.Network(20, 25).planes(flow))
    assert np.allclose(back - back[0, 0], u - u[0, 0])


def test_laplace_recovers_a_ramp_and_is_congruent():
    r, c = np.indices((50, 60))
    u = 0.1 * r + 0.2 * c
    out = S.laplace(wrapped(u), np.ones((49, 60)), np.ones((50, 59)))
    assert np.allclose(out - out[0, 0], u - u[0, 0], atol=1e-6)
    psi = wrapped(noisy((40, 40), 1.5, 3))
    out = S.laplace(psi, np.ones((39, 40)), np.ones((40, 39)), LaplaceOptions(reweights=4))
    assert np.isfinite(out).all() and np.abs(S.wrap(out - psi)).max() < 1e-9


def test_stencil_is_symmetric():
    rng = np.random.default_rng(1)
    s = S.Stencil(rng.random((6, 8)), rng.random((7, 7)))
    a, b = rng.random((7, 8)), rng.random((7, 8))
    assert np.isclose((a * s.apply(b)).sum(), (b * s.apply(a)).sum())
    assert np.isclose(s.apply(np.eye(1, 56, 9).reshape(7, 8))[1, 1], s.diagonal()[1, 1])


def test_convex_costs():
    rng = np.random.default_rng(2)
    k = np.arange(-6, 7)
    for _ in range(200):
        off, var = int(rng.integers(-200, 200)), int(rng.integers(1, 32000))
        assert (np.diff((k * 200 + off) ** 2 // var, 2) >= 0).all()
    assert CostModel().short_cycle == 200
