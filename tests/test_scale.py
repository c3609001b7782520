"""Plans that grow no faster than their input."""

import os

import numpy as np

from phasegrid.operators import bridge as B
from phasegrid.operators import components, flow, grid, seams
from phasegrid.operators.graph import checkpoint_dir
from phasegrid.sources import from_arrays


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def flat(spark, nrow=6, ncol=8):


    return from_arrays(spark, unw=np.zeros((nrow, ncol)), mask=np.ones((nrow, ncol), bool))


def test_dilation_has_running_frames_only(spark):
    """A frame that ends at the last row is read anew for each row: quadratic in the line."""
    assert "unboundedfollowing" not in plan_of(grid.dilate(flat(spark), 2))


def test_gap_filling_has_running_frames_only(spark):
    filled = seams.fill_gaps(seams.moving_median(seams.seam_profile(flat(spark), 4)))
    assert "unboundedfollowing" not in plan_of(filled)


def test_relaxation_joins_by_shuffles(spark):
    """There are as many nodes as loops: their table is made in parts, and nothing of that size is broadcast."""
    edges = spark.range(8).selectExpr("'s' AS scene", "id AS src", "id + 1 AS dst", "CAST(1 AS INT) AS cost")
    nodes = flow.network_nodes(edges, (4, 4))
    assert sorted(tuple(r) for r in nodes.collect()) == [("s", k, 0) for k in range(10)]
    plan = plan_of(flow.relax(edges, nodes))
    assert "BroadcastHashJoin" not in plan and "sequence" not in plan


def test_runs_are_made_once(spark):
    """The graph and the labels read the runs; the second reader must not make them again."""
    df = flat(spark)
    labels = components.label_runs(df, (6, 8), df["mask"], "unw")
    assert "Window" not in plan_of(labels) and labels.where("root = 0").count() == 48


def test_many_seams_are_one_plan(spark):
    """Four hundred seams within each other's feather: no table is written for each."""
    df, at = flat(spark, 1000, 3), checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: len(os.listdir(at)) if os.path.isdir(at) else 0
    before = tables()
    steps = seams.seam_steps(df, seams.seam_places(1000, 400, 0), 6, "row")
    assert tables() == before
    out = seams.seams_apply(df, steps, 6, "row")
    assert steps.count() == 3 * 399 and out.where("unw = 0").count() == 3000


def test_tree_pairs_give_the_tree_of_all_pairs(spark):
    """Close regions, equal distances and one far away: the tree of the few pairs is that of all."""
    rng = np.random.default_rng(3)
    cells = {(int(r), int(c)) for r, c in rng.integers(0, 30, (40, 2))} | {(70, 3), (71, 60)}
    rows = [("s", k, 2 * r + i, 2 * c, i) for k, (r, c) in enumerate(sorted(cells), 1) for i in (0, 1)]
    points = spark.createDataFrame(rows, "scene string, label long, row int, col int, local int")
    every = {(r["li"], r["lj"]): (r["q"], r["y0"], r["x0"], r["y1"], r["x1"]) for r in B.nearest_pairs(points).collect()}
    few = B.tree_pairs(points)["s"]
    assert len(few) < len(every) / 3 and all(every[k] == r for k, r in few.items())
    short = lambda pairs: {k: r[0] for k, r in pairs.items()}
    n = len(cells)
    for root in (1, 9, n):
        tree = B.spanning_tree(short(few), n, root)
        assert len(tree) == n - 1 and tree == B.spanning_tree(short(every), n, root) == plain_tree(short(every), n, root)


def plain_tree(pairs, n, root):
    """Prim's algorithm over all pairs."""
    best, children = {j: (pairs[root, j], root) for j in range(1, n + 1) if j != root}, {}
    while best:
        j = min(best, key=lambda k: (best[k][0], k))
        parent = best.pop(j)[1]
        children.setdefault(parent, []).append(j)
        for k in best:
            if pairs[j, k] < best[k][0]:
                best[k] = (pairs[j, k], j)
    order, queue = [], [root]
    for u in queue:
        order += [(u, v) for v in children.get(u, [])]
        queue += children.get(u, [])
    return order


def test_nearest_pairs_are_dealt_in_blocks(spark):
    """No row for two regions is shuffled; points and ties are those of all point pairs."""
    rng = np.random.default_rng(5)
    where = {k: rng.integers(0, 25, (int(rng.integers(1, 40)), 2)) + [30 * (k // 4), 30 * (k % 4)] for k in range(1, 9)}
    points = spark.createDataFrame([("s", 200 * k, i, int(r), int(c)) for k, p in where.items() for i, (r, c) in enumerate(p)], "scene string, label long, local int, row int, col int")
    found = B.nearest_pairs(points)
    assert not any("hashpartitioning" in line and "li#" in line for line in plan_of(found).splitlines())
    key = lambda a, b, i, j: (int(np.floor(np.sqrt(float(((a[i] - b[j]) ** 2).sum())) * 64)), i, j)
    want = {}
    for x, a in where.items():
        for y, b in where.items():
            if x != y:
                q, i, j = min(key(a, b, i, j) for i in range(len(a)) for j in range(len(b)))
                want[200 * x, 200 * y] = (q, *map(int, a[i]), *map(int, b[j]))
    assert {(r["li"], r["lj"]): (r["q"], r["y0"], r["x0"], r["y1"], r["x1"]) for r in found.collect()} == want
