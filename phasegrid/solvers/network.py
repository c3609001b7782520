"""Flows on a raster's residual network, as array operations.

Nodes are the 2 x 2 loops of the raster and the ground round it; an arc between
two pixels carries whole cycles between the loops on its two sides.  An arc's
cost is a function of its flow; what the solvers see are the costs of one step
up and one step down.

`least_cost_flow` starts with each arc at its own cheapest flow and clears the
loops' surpluses along shortest paths.  A phase finds the distance of every node
to the nearest deficit (sweeps along lines, one prefix minimum each), makes it
the potential, and sends units down the tree, each arc changing once a phase.
Nearly all surpluses go in a few phases.  When a phase clears little, the rest
go one by one, each by a search that ends at its nearest deficit.  For convex
costs that ends at the optimum, whatever the size of the costs.

`cancel_cycles` lowers any cost from any flow: relaxation over the whole grid
at once, and all cycles that the predecessors form are cancelled together.  It
ends when no cycle of any step length up to `max_flow` lowers the cost.

A tile's planes are the bound of memory: about 300 bytes a pixel.
"""

from __future__ import annotations

from array import array
from heapq import heappop, heappush

import numpy as np

NO_PREFERENCE = 32000
FAR, SHUT = np.int64(1) << 56, np.int64(1) << 36
#: A phase that leaves more than this share of the surplus is the last.
SLOW = 0.5
RIGHT, LEFT, DOWN, UP, HERE = 0, 1, 2, 3, 4


class Network:
    """Residual arcs of a raster: row arcs first, then column arcs; the ground is the last node."""

    def __init__(self, nrow: int, ncol: int):
        self.nrow, self.ncol = nrow, ncol
        self.shape = nrow - 1, ncol - 1
        self.ground = (nrow - 1) * (ncol - 1)
        self.n_row = (nrow - 1) * ncol
        self.n_arcs = self.n_row + nrow * (ncol - 1)

    def planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Views of arc values: row arcs (between loops of a line), column arcs."""
        return x[: self.n_row].reshape(self.nrow - 1, self.ncol), x[self.n_row :].reshape(self.nrow, self.ncol - 1)

    def excess(self, flow: np.ndarray) -> np.ndarray:
        """What flows into each node less what flows out."""
        r, c = self.planes(flow)
        inner = r[:, :-1] - r[:, 1:] + c[:-1] - c[1:]
        return np.append(inner.ravel(), -inner.sum())

    def masked_arcs(self, magnitude: np.ndarray) -> np.ndarray:
        """Arcs that touch a loop whose four pixels all have no magnitude."""
        none = magnitude == 0
        loops = np.zeros((self.nrow + 1, self.ncol + 1), bool)
        loops[1:-1, 1:-1] = none[:-1, :-1] & none[:-1, 1:] & none[1:, :-1] & none[1:, 1:]
        r, c = loops[1:-1], loops[:, 1:-1]
        return np.concatenate([(r[:, :-1] | r[:, 1:]).ravel(), (c[:-1] | c[1:]).ravel()])

    def step(self, node: int, way: int) -> tuple[int, int, int]:
        """(arc, sign, next node) of a move from a loop."""
        i, j = divmod(node, self.ncol - 1)
        if way == RIGHT:
            return i * self.ncol + j + 1, 1, node + 1 if j + 2 < self.ncol else self.ground
        if way == LEFT:
            return i * self.ncol + j, -1, node - 1 if j else self.ground
        if way == DOWN:
            return self.n_row + (i + 1) * (self.ncol - 1) + j, 1, node + self.ncol - 1 if i + 2 < self.nrow else self.ground
        return self.n_row + node, -1, node - self.ncol + 1 if i else self.ground

    def border(self, up: np.ndarray, down: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Moves out of the ground: (arcs, signs, loops reached, costs beyond), `d` the loops' values."""
        m, n = self.shape
        r, c = np.arange(m), np.arange(n)
        arcs = np.concatenate([r * self.ncol, r * self.ncol + self.ncol - 1, self.n_row + c, self.n_row + (self.nrow - 1) * n + c])
        signs = np.concatenate([np.ones(m, int), -np.ones(m, int), np.ones(n, int), -np.ones(n, int)])
        loops = np.concatenate([r * n, r * n + n - 1, c, (m - 1) * n + c])
        return arcs, signs, loops, np.where(signs > 0, up[arcs], down[arcs]) + d.ravel()[loops]


class LinearCost:
    """A weight for each unit in either direction."""

    convex = True

    def __init__(self, weight: np.ndarray):
        self.weight = weight.astype(np.int64)

    def least(self) -> np.ndarray:
        return np.zeros(len(self.weight), np.int64)

    def at(self, flow: np.ndarray, arcs=slice(None)) -> np.ndarray:
        return np.abs(flow) * self.weight[arcs]


class SmoothCost:
    """Whole part of z * z / sigsq, z the flow in short cycles off the expected step; 0 without preference."""

    convex = True

    def __init__(self, offset: np.ndarray, sigsq: np.ndarray, short_cycle: int):
        self.offset, self.ns = offset.astype(np.int64), short_cycle
        self.free = sigsq == NO_PREFERENCE
        self.sigsq = np.maximum(sigsq.astype(np.int64), 1)

    def least(self) -> np.ndarray:
        return np.where(self.free, 0, np.rint(-self.offset / self.ns).astype(np.int64))

    def at(self, flow: np.ndarray, arcs=slice(None)) -> np.ndarray:
        z = flow * self.ns + self.offset[arcs]
        return np.where(self.free[arcs], 0, z * z // self.sigsq[arcs])


class DefoCost(SmoothCost):
    """The smooth cost up to a shelf `laycost`; beyond `dzmax` it rises from the shelf at half the rate. Not convex."""

    convex = False

    def __init__(self, offset, sigsq, dzmax, laycost, short_cycle: int):
        super().__init__(offset, sigsq, short_cycle)
        self.dzmax, self.laycost = dzmax.astype(np.int64), laycost.astype(np.int64)

    def at(self, flow: np.ndarray, arcs=slice(None)) -> np.ndarray:
        z, s, shelf = np.abs(flow * self.ns + self.offset[arcs]), self.sigsq[arcs], self.laycost[arcs]
        beyond = np.maximum(z - self.dzmax[arcs], 0)
        cost = np.where(beyond > 0, shelf + beyond * beyond // (2 * s), np.minimum(z * z // s, shelf))
        return np.where(self.free[arcs], 0, cost)


class Closed:
    """Another cost with some arcs held at their flows: any other flow there costs more than all else together."""

    def __init__(self, cost, closed: np.ndarray, flow: np.ndarray):
        self.cost, self.closed, self.flow, self.convex = cost, closed, flow.astype(np.int64), cost.convex

    def least(self) -> np.ndarray:
        return np.where(self.closed, self.flow, self.cost.least())

    def at(self, flow: np.ndarray, arcs=slice(None)) -> np.ndarray:
        return np.where(self.closed[arcs], np.abs(flow - self.flow[arcs]) * SHUT, self.cost.at(flow, arcs))


def steps(cost, flow: np.ndarray, n: int = 1, arcs=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Cost of n units more and of n units less."""
    now = cost.at(flow, arcs)
    return cost.at(flow + n, arcs) - now, cost.at(flow - n, arcs) - now


# ---------------------------------------------------------------- shortest paths


def _sweep(d: np.ndarray, way: np.ndarray, cost: np.ndarray, axis: int, back: bool, name: int) -> bool:
    """Paths along one direction, any number of moves at once: cost[k] is that of leaving place k."""
    x, c, w = (np.moveaxis(a, axis, 0) for a in (d, cost, way))
    if back:
        x, c, w = x[::-1], c[::-1], w[::-1]
    # x[k] may become x[k - 1] + c[k], and so on down the line.
    s = np.cumsum(c, axis=0)
    new = np.minimum.accumulate(x - s, axis=0) + s
    better = new < x
    if not better.any():
        return False
    x[better] = new[better]
    w[better] = name
    return True


def _distances(net: Network, up: np.ndarray, down: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, tuple[int, int, int] | None]:
    """Distance of each loop and of the ground to the nearest deficit, and the first move there."""
    m, n = net.shape
    d = np.where(deficit[:-1], 0, FAR).reshape(m, n)
    way = np.full((m, n), HERE, np.int8)
    far = 0 if deficit[-1] else int(FAR)
    exit_ = None
    (up_r, up_c), (down_r, down_c) = net.planes(up), net.planes(down)
    while True:
        changed = False
        arcs, signs, loops, reach = net.border(up, down, d)
        k = int(reach.argmin())
        if reach[k] < far:
            far, exit_, changed = int(reach[k]), (int(arcs[k]), int(signs[k]), int(loops[k])), True
        if far < FAR:
            for name, line, own in ((RIGHT, np.s_[:, -1], up_r[:, -1]), (LEFT, np.s_[:, 0], down_r[:, 0]), (DOWN, np.s_[-1], up_c[-1]), (UP, np.s_[0], down_c[0])):
                better = own + far < d[line]
                if better.any():
                    d[line] = np.where(better, own + far, d[line])
                    way[line] = np.where(better, name, way[line])
                    changed = True
        # Leaving to the right: cost of row arc j + 1, relaxed from the right end on.
        changed |= _sweep(d, way, up_r[:, 1:], 1, True, RIGHT)
        changed |= _sweep(d, way, down_r[:, :-1], 1, False, LEFT)
        changed |= _sweep(d, way, up_c[1:], 0, True, DOWN)
        changed |= _sweep(d, way, down_c[:-1], 0, False, UP)
        if not changed:
            return d, way, far, exit_


def least_cost_flow(net: Network, supply: np.ndarray, cost) -> np.ndarray:
    """The flow of least convex cost that takes `supply` out of each loop; the ground takes the rest.

    With several flows of equal cost, any of them.
    """
    flow = cost.least()
    excess = np.append(supply, -supply.sum()) + net.excess(flow)
    up, down = steps(cost, flow)
    if net.ground == 0:
        return flow
    surplus, before = int(np.maximum(excess, 0).sum()), None
    while surplus and (before is None or surplus < SLOW * before):
        d, way, far, exit_ = _distances(net, up, down, excess < 0)
        # Distances become potentials: no step costs less than nothing, and the tree's cost nothing.
        wide = np.full((net.shape[0] + 2, net.shape[1] + 2), far, np.int64)
        wide[1:-1, 1:-1] = d
        for x, sign in ((up, 1), (down, -1)):
            r, c = net.planes(x)
            r += sign * np.diff(wide[1:-1], axis=1)
            c += sign * np.diff(wide[:, 1:-1], axis=0)
        sources = np.flatnonzero(excess > 0)
        dist = np.append(d.ravel(), far)[sources]
        left, ways = excess.tolist(), way.ravel()
        used: dict[int, int] = {}
        for s in sources[np.argsort(dist, kind="stable")].tolist():
            for _ in range(left[s]):
                path, at = [], s
                while True:
                    if at == net.ground:
                        move = exit_
                    else:
                        w = int(ways[at])
                        move = None if w == HERE else net.step(at, w)
                    if move is None or move[0] in used:
                        break
                    path.append(move[:2])
                    at = move[2]
                if move is not None or left[at] >= 0:
                    break
                used.update(path)
                left[s] -= 1
                left[at] += 1
        excess = np.array(left)
        arcs, signs = np.array(list(used)), np.array(list(used.values()))
        old = steps(cost, flow[arcs], 1, arcs)
        flow[arcs] += signs
        new = steps(cost, flow[arcs], 1, arcs)
        up[arcs] += new[0] - old[0]
        down[arcs] += new[1] - old[1]
        before, surplus = surplus, int(np.maximum(excess, 0).sum())
    if surplus:
        _one_by_one(net, flow, excess.tolist(), up, down, cost)
    return flow


def _one_by_one(net: Network, flow: np.ndarray, left: list[int], up_: np.ndarray, down_: np.ndarray, cost) -> None:
    """Shortest paths from one surplus at a time; costs of steps are reduced ones, none below zero."""
    width, ncol, n_row, ground = net.ncol - 1, net.ncol, net.n_row, net.ground
    last = ground - width
    up, down = array("q", up_.tobytes()), array("q", down_.tobytes())
    potential = array("q", bytes(8 * (ground + 1)))
    edge = [x.tolist() for x in net.border(up_, down_, np.zeros(net.shape, np.int64))[:3]]
    for source in [k for k, e in enumerate(left) if e > 0 for _ in range(e)]:
        dist, via, done = {source: 0}, {}, set()
        heap = [(0, source)]
        while True:
            d, v = heappop(heap)
            if v in done:
                continue
            done.add(v)
            if left[v] < 0:
                break
            base = d + potential[v]
            if v == ground:
                moves = zip(*edge, strict=True)
            else:
                i, j = divmod(v, width)
                a, c = i * ncol + j, n_row + v
                moves = (
                    (a + 1, 1, v + 1 if j + 1 < width else ground), (a, -1, v - 1 if j else ground),
                    (c + width, 1, v + width if v < last else ground), (c, -1, v - width if i else ground),
                )
            for arc, sign, w in moves:
                new = base + (up[arc] if sign > 0 else down[arc]) - potential[w]
                if w not in dist or new < dist[w]:
                    dist[w] = new
                    via[w] = (arc, sign, v)
                    heappush(heap, (new, w))
        for w in done:
            potential[w] += dist[w] - d
        left[source] -= 1
        left[v] += 1
        path = []
        while v != source:
            arc, sign, v = via[v]
            path.append((arc, sign))
        arcs, signs = np.array(path).T
        old = steps(cost, flow[arcs], 1, arcs)
        flow[arcs] += signs
        new_up, new_down = steps(cost, flow[arcs], 1, arcs)
        for arc, x, y in zip(arcs.tolist(), (new_up - old[0]).tolist(), (new_down - old[1]).tolist(), strict=True):
            up[arc] += x
            down[arc] += y


def improved_flow(net: Network, flow: np.ndarray, cost, max_flow: int = 1, closed: np.ndarray | None = None, early_exit: bool = True) -> np.ndarray:
    """A flow with the same surpluses that no cycle makes cheaper; `closed` arcs keep their flows.

    A convex cost has one least value whatever the start, and shortest paths
    find it; other costs are lowered from the start in steps of 1 to `max_flow`.
    With `early_exit` a flow that no single step makes cheaper stays.
    """
    flow = flow.astype(np.int64)
    if closed is not None and closed.any():
        cost = Closed(cost, closed, flow)
    if early_exit and min(x.min(initial=0) for x in steps(cost, flow)) >= 0:
        return flow
    if cost.convex:
        return least_cost_flow(net, -net.excess(flow)[:-1], cost)
    return cancel_cycles(net, flow, cost, max_flow)


# ---------------------------------------------------------------- cycles


def _cycles(move: np.ndarray) -> list[list[int]]:
    """Cycles of the graph in which node k goes to move[k]; a node that goes nowhere goes to itself."""
    at = move
    for _ in range(int(len(move)).bit_length()):
        at = at[at]
    on = np.unique(at)
    on = on[move[on] != on]
    out, seen = [], set()
    for k in on.tolist():
        if k in seen:
            continue
        cycle, x = [], k
        while x not in seen:
            seen.add(x)
            cycle.append(x)
            x = int(move[x])
        out.append(cycle)
    return out


def cancel_cycles(net: Network, flow: np.ndarray, cost, max_flow: int = 1) -> np.ndarray:
    """The flow after cancelling cycles of 1 to `max_flow` units until none lowers the cost."""
    flow = flow.astype(np.int64).copy()
    done, n = 0, 1
    while done < max_flow:
        done = 0 if _cancel(net, flow, cost, n) else done + 1
        n = n % max_flow + 1
    return flow


def _cancel(net: Network, flow: np.ndarray, cost, n: int, batch: int = 6) -> bool:
    """Cancels all cycles of n units that lower the cost; whether there were any."""
    if net.ground == 0:
        return False
    m, w = net.shape
    nodes = np.arange(net.ground + 1)
    d = np.zeros(net.ground + 1, np.int64)
    move, arc, sign = nodes.copy(), np.zeros(net.ground + 1, np.int64), np.zeros(net.ground + 1, np.int64)
    up, down = _two_ways(*steps(cost, flow, n))
    (ur, uc), (dr, dc) = net.planes(up), net.planes(down)
    index = np.arange(net.n_arcs)
    ir, ic = net.planes(index)
    wide = np.empty((m + 2, w + 2), np.int64)
    name = np.full((m + 2, w + 2), net.ground)
    name[1:-1, 1:-1] = nodes[:-1].reshape(m, w)
    any_, turn = False, 0
    while True:
        wide[:] = d[-1]
        inner = wide[1:-1, 1:-1]
        inner[:] = d[:-1].reshape(m, w)
        changed = False
        for way, own, at, plus in ((np.s_[1:-1, 2:], ur[:, 1:], ir[:, 1:], 1), (np.s_[1:-1, :-2], dr[:, :-1], ir[:, :-1], -1), (np.s_[2:, 1:-1], uc[1:], ic[1:], 1), (np.s_[:-2, 1:-1], dc[:-1], ic[:-1], -1)):
            new = wide[way] + own
            better = new < inner
            if better.any():
                changed = True
                k = np.flatnonzero(better)
                inner[better] = new[better]
                move[k], arc[k], sign[k] = name[way][better], at[better], plus
        d[:-1] = inner.ravel()
        arcs, signs, loops, reach = net.border(up, down, d[:-1])
        k = int(reach.argmin())
        if reach[k] < d[-1]:
            d[-1], move[-1], arc[-1], sign[-1], changed = reach[k], loops[k], arcs[k], signs[k], True
        turn += 1
        if changed and turn % batch:
            continue
        found = _cycles(move)
        if not changed and not found:
            return any_
        for cycle in found:
            x = np.array(cycle)
            a, s = arc[x], sign[x]
            move[x] = x
            if len(np.unique(a)) < len(a):
                continue  # up and down one arc is no cycle
            change = int((cost.at(flow[a] + n * s, a) - cost.at(flow[a], a)).sum())
            if change < 0:
                flow[a] += n * s
                up[a], down[a] = _two_ways(*steps(cost, flow[a], n, a))
                any_ = True


def _two_ways(up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both steps would gain, only the better counts: going there and back gains nothing."""
    both = up + down < 0
    return np.where(both & (up > down), -down, up), np.where(both & (up <= down), -up, down)
