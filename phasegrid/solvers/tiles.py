"""Solvers of one tile, run as grouped table functions.

A tile is the unit of memory: its planes are dense numpy arrays in one worker.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.options import CostModel, LaplaceOptions
from phasegrid.solvers.network import NO_PREFERENCE, DefoCost, LinearCost, Network, SmoothCost, improved_flow, least_cost_flow, steps

TWO_PI = 2 * np.pi
EPSILON = 1e-12  # fixed value: keeps the normal equations definite


def wrap(x: np.ndarray) -> np.ndarray:
    return x - TWO_PI * np.rint(x / TWO_PI)


# ---------------------------------------------------------------- least squares


class Stencil:
    """Weighted differences of a grid: normal equations as array operations."""

    def __init__(self, w_row: np.ndarray, w_col: np.ndarray):
        self.w_row, self.w_col = w_row, w_col

    def spread(self, g_row: np.ndarray, g_col: np.ndarray) -> np.ndarray:
        """Transposed differences of the weighted arc values."""
        return self._spread(self.w_row * g_row, self.w_col * g_col)

    def _spread(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((b.shape[0], a.shape[1]))
        out[:-1] -= a
        out[1:] += a
        out[:, :-1] -= b
        out[:, 1:] += b
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        # Small tiles: each call costs as much as its arithmetic, so differences are slices and products stay in place.
        a, b = x[1:] - x[:-1], x[:, 1:] - x[:, :-1]
        a *= self.w_row
        b *= self.w_col
        out = self._spread(a, b)
        out += EPSILON * x
        return out

    def diagonal(self) -> np.ndarray:
        out = np.full((self.w_col.shape[0], self.w_row.shape[1]), EPSILON)
        out[:-1] += self.w_row
        out[1:] += self.w_row
        out[:, :-1] += self.w_col
        out[:, 1:] += self.w_col
        return out


def conjugate_gradients(s: Stencil, b: np.ndarray, x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Jacobi-preconditioned, from x."""
    d = s.diagonal()
    r = b - s.apply(x)
    z = r / d
    p, rz = z.copy(), float((r * z).sum())
    goal = tol * tol * rz
    for _ in range(max_iter):
        if rz <= goal or rz == 0:
            break
        q = s.apply(p)
        pq = float((p * q).sum())
        if pq <= 0:
            break
        a = rz / pq
        x = x + a * p
        q *= a
        r -= q
        np.divide(r, d, out=z)
        rz, old = float((r * z).sum()), rz
        p *= rz / old
        p += z
    return x


def laplace(psi: np.ndarray, w_row: np.ndarray, w_col: np.ndarray, options: LaplaceOptions | None = None) -> np.ndarray:
    """Weighted least squares, reweighted towards least absolute errors, anchored, made congruent."""
    o = options or LaplaceOptions()
    g_row, g_col = wrap(np.diff(psi, axis=0)), wrap(np.diff(psi, axis=1))
    s = Stencil(w_row, w_col)
    u = conjugate_gradients(s, s.spread(g_row, g_col), np.zeros_like(psi), o.max_iter, o.tol)
    for k in range(o.reweights):
        delta = max(o.delta_min, o.delta_max * 0.5**k)
        s = Stencil(w_row / np.sqrt((np.diff(u, axis=0) - g_row) ** 2 + delta**2), w_col / np.sqrt((np.diff(u, axis=1) - g_col) ** 2 + delta**2))
        u = conjugate_gradients(s, s.spread(g_row, g_col), u, o.max_iter, o.tol)
    u = u + psi[0, 0] - u[0, 0]
    return psi + TWO_PI * np.rint((u - psi) / TWO_PI)


# ---------------------------------------------------------------- network flow


def residue_supply(psi: np.ndarray) -> np.ndarray:
    """What each loop must send out: the arcs' flows have the opposite curl."""
    d_col, d_row = wrap(np.diff(psi, axis=1)) / TWO_PI, -wrap(np.diff(psi, axis=0)) / TWO_PI
    curl = np.rint(d_col[:-1] - d_row[:, 1:] - d_col[1:] + d_row[:, :-1]).astype(np.int64)
    return curl.ravel()


def integrate(psi: np.ndarray, k_row: np.ndarray, k_col: np.ndarray) -> np.ndarray:
    first = np.concatenate([[psi[0, 0]], wrap(np.diff(psi[:, 0])) - TWO_PI * k_row[:, 0]]).cumsum()
    steps = wrap(np.diff(psi, axis=1)) + TWO_PI * k_col
    return np.concatenate([first[:, None], steps], axis=1).cumsum(axis=1)


def flows_of(psi: np.ndarray, unw: np.ndarray) -> np.ndarray:
    """The flow that an unwrapped raster implies, rows then columns."""
    k_row = -np.rint((np.diff(unw, axis=0) - wrap(np.diff(psi, axis=0))) / TWO_PI)
    k_col = np.rint((np.diff(unw, axis=1) - wrap(np.diff(psi, axis=1))) / TWO_PI)
    return np.concatenate([k_row.ravel(), k_col.ravel()]).astype(np.int64)


def tree_flow(psi: np.ndarray, weight_row: np.ndarray, weight_col: np.ndarray) -> np.ndarray:
    """Flows of the surface unwrapped along a spanning tree of the most certain steps (largest weight first)."""
    nrow, ncol = psi.shape
    a_row, a_col = np.arange(nrow * ncol).reshape(nrow, ncol)[:-1], np.arange(nrow * ncol).reshape(nrow, ncol)[:, :-1]
    ends = np.concatenate([np.stack([a_row.ravel(), a_row.ravel() + ncol], 1), np.stack([a_col.ravel(), a_col.ravel() + 1], 1)])
    order = np.argsort(-np.concatenate([weight_row.ravel(), weight_col.ravel()]), kind="stable")
    root = list(range(nrow * ncol))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    near: list[list[int]] = [[] for _ in root]
    for a, b in ends[order].tolist():
        p, q = find(a), find(b)
        if p != q:
            root[q] = p
            near[a].append(b)
            near[b].append(a)
    flat = psi.ravel()
    u, seen, queue = flat.copy(), np.zeros(len(flat), bool), deque([0])
    seen[0] = True
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if not seen[b]:
                seen[b] = True
                u[b] = u[a] + wrap(flat[b] - flat[a])
                queue.append(b)
    return flows_of(psi, u.reshape(psi.shape))


# ---------------------------------------------------------------- table functions


def _plane(t: pd.DataFrame, value: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[t["row"].to_numpy(), t["col"].to_numpy()] = t[value].to_numpy()
    return out


def _cost(t: dict[str, np.ndarray], model: CostModel):
    """The cost of arcs with (offset, sigsq) or, with (dzmax, laycost) too, of deformation."""
    if "dzmax" in t:
        return DefoCost(t["offset"], t["sigsq"], t["dzmax"], t["laycost"], model.short_cycle)
    return SmoothCost(t["offset"], t["sigsq"], model.short_cycle)


def refine_flows(arcs: DataFrame, shape: tuple[int, int], model: CostModel = CostModel(), flow: str = "flow") -> DataFrame:
    """(scene, axis, row, col, flow): each scene's flows when no cycle makes them cheaper.

    A scene is one task's: about 300 bytes a pixel, 20 s for a million noisy pixels.
    """
    nrow, ncol = shape
    kinds = ["offset", "sigsq", *(c for c in ("dzmax", "laycost") if c in arcs.columns)]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        net = Network(nrow, ncol)
        is_row = (t["axis"] == "row").to_numpy()
        at = np.where(is_row, t["row"] * ncol + t["col"], net.n_row + t["row"] * (ncol - 1) + t["col"])
        full = {k: np.full(net.n_arcs, NO_PREFERENCE if k == "sigsq" else 0, np.int64) for k in (*kinds, flow)}
        for k, x in full.items():
            x[at] = t[k]
        done = improved_flow(net, full[flow], _cost(full, model), model.max_flow, early_exit=False)
        return pd.DataFrame({"scene": t["scene"], "axis": t["axis"], "row": t["row"], "col": t["col"], "flow": done[at].astype(np.int16)})

    return arcs.select("scene", "axis", "row", "col", *kinds, flow).groupBy("scene").applyInPandas(run, "scene string, axis string, row int, col int, flow short")


def solve_tile(psi: np.ndarray, arcs: dict[str, np.ndarray], magnitude: np.ndarray, init: str, model: CostModel, laplace_options: LaplaceOptions, early_exit: bool = True) -> np.ndarray:
    """The unwrapped plane of one tile; `arcs` has the arcs' costs, row arcs first."""
    net = Network(*psi.shape)
    weight = np.where((arcs["sigsq"] > 0) & (arcs["sigsq"] < NO_PREFERENCE), 1.0 / np.maximum(arcs["sigsq"], 1), 0.0)
    if min(psi.shape) < 2:  # a line has no loops: its steps are what they are
        return integrate(psi, *net.planes(np.zeros(net.n_arcs)))
    if init == "laplace":
        return laplace(psi, *net.planes(weight), laplace_options)
    cost, closed = _cost(arcs, model), net.masked_arcs(magnitude)
    if init == "mcf" and cost.convex and not closed.any():
        flow = least_cost_flow(net, residue_supply(psi), cost)  # the optimum at once
    else:
        if init == "mst":
            flow = tree_flow(psi, *net.planes(weight))
        else:
            cheap = np.minimum(*steps(cost, np.zeros(net.n_arcs, np.int64)))
            flow = least_cost_flow(net, residue_supply(psi), LinearCost(np.clip(cheap, model.min_cost, model.max_cost)))
        flow = improved_flow(net, flow, cost, model.max_flow, closed, early_exit)
    return integrate(psi, *net.planes(flow))


def solve_tiles(pixels: DataFrame, init: str, model: CostModel, laplace_options: LaplaceOptions, early_exit: bool = True) -> DataFrame:
    """(scene, tr, tc, row, col, unw) of pixels with psi, mag and the costs of their arcs (offset_r, offset_c, ...).

    Arcs without costs (at the tile's last row and column) have nulls; without `mag` it is 1.
    """
    kinds = [k for k in ("offset", "sigsq", "dzmax", "laycost") if f"{k}_r" in pixels.columns]
    pixels = pixels if "mag" in pixels.columns else pixels.withColumn("mag", F.lit(1.0))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(t["row"].min()), int(t["col"].min())
        shape = int(t["row"].max()) - r0 + 1, int(t["col"].max()) - c0 + 1
        own = t.assign(row=t["row"] - r0, col=t["col"] - c0)
        arcs = {}
        for k in kinds:
            own = own.fillna({f"{k}_{x}": NO_PREFERENCE if k == "sigsq" else 0 for x in "rc"})
            arcs[k] = np.concatenate([_plane(own, f"{k}_r", shape)[:-1].ravel(), _plane(own, f"{k}_c", shape)[:, :-1].ravel()]).astype(np.int64)
        u = solve_tile(_plane(own, "psi", shape), arcs, _plane(own, "mag", shape), init, model, laplace_options, early_exit)
        at = own["row"].to_numpy(), own["col"].to_numpy()
        return pd.DataFrame({"scene": t["scene"], "tr": t["tr"], "tc": t["tc"], "row": t["row"], "col": t["col"], "unw": u[at]})

    cols = ["scene", "tr", "tc", "row", "col", "psi", "mag", *(f"{k}_{x}" for k in kinds for x in "rc")]
    return pixels.select(*cols).groupBy("scene", "tr", "tc").applyInPandas(run, "scene string, tr int, tc int, row int, col int, unw double")
