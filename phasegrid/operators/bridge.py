"""Bridging of regions that no valid pixels connect.

The number of regions and bridges is bounded by the scene's pixels over the
smallest region; only such tables (and a <= 6 x 6 system) reach the driver,
never pixels, and never a row for every two regions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import TWO_PI, ramp_terms
from phasegrid.operators.components import compact, label_runs
from phasegrid.operators.graph import written
from phasegrid.operators.grid import along
from phasegrid.operators.seams import upper_median
from phasegrid.options import BridgeOptions


def region_labels(df: DataFrame, shape: tuple[int, int], min_num_pixel: int = 1, unw: str = "unw") -> DataFrame:
    """(scene, row, col, label): 8-connected regions of nonzero valid pixels, in raster order of their roots."""
    solid = (F.col(unw) != 0) & (F.col("mask") if "mask" in df.columns else F.lit(True))
    labels = label_runs(df, shape, F.coalesce(solid, F.lit(False)), diagonal=True)
    return compact(labels, shape, max_ncomps=2**62, min_size=min_num_pixel).withColumnRenamed("conncomp", "label")


def relabel(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Labels of the kept regions as 1, 2, ..., others 0."""
    number = F.row_number().over(Window.partitionBy("scene").orderBy("label"))
    table = kept.select("scene", "label", number.alias("_new"))
    return df.join(table, ["scene", "label"], "left").withColumn("label", F.coalesce("_new", F.lit(0)).cast("long")).drop("_new")


def erosion_survivors(labels: DataFrame, shape: tuple[int, int], size: int, circular: bool) -> DataFrame:
    """(scene, label) of regions with a pixel whose whole neighbourhood is inside the raster and labelled.

    A square is two windowed minima; a disc is one horizontal span for each of
    its rows, so each is again a windowed minimum along the rows.
    """
    nrow, ncol = shape
    across, down = along("row"), along("col")
    df = labels.withColumn("_on", F.when(F.col("label") > 0, 1).otherwise(0))
    full = F.lit(True)
    names = []
    for half in sorted({math.isqrt(size * size - dr * dr) if circular else size for dr in range(size + 1)}):
        name = f"_h{half}"
        names.append(name)
        df = df.withColumn(name, F.when((F.col("col") >= half) & (F.col("col") < ncol - half), F.min("_on").over(across.rowsBetween(-half, half))).otherwise(0))
    for dr in range(size + 1):
        half = math.isqrt(size * size - dr * dr) if circular else size
        for line in {dr, -dr}:
            full = full & (F.coalesce(F.lead(f"_h{half}", line).over(down) if line >= 0 else F.lag(f"_h{half}", -line).over(down), F.lit(0)) == 1)
    return df.withColumn("_full", full).where("_full AND label > 0").select("scene", "label").distinct()


def erode_prune(labels: DataFrame, shape: tuple[int, int], size: int, circular: bool) -> DataFrame:
    """Drop the regions that erosion removes wholly; the others keep their shape."""
    return relabel(labels, erosion_survivors(labels, shape, size, circular)) if size > 0 else labels


def reference_region(labels: DataFrame) -> DataFrame:
    """(scene, label, n): the largest region, the lowest label of equals."""
    sizes = labels.where("label > 0").groupBy("scene", "label").agg(F.count("*").alias("n"))
    best = sizes.groupBy("scene").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"))
    return best.select("scene", (-F.col("b.l")).alias("label"), F.col("b.n").alias("n"))


def ramp_sums(df: DataFrame, kind: str, step: int = 1, unw: str = "unw") -> DataFrame:
    """(scene, g_i_j, y_i): normal equations of a ramp over the given pixels, on a grid of every `step` lines."""
    if step > 1:
        df = df.where((F.col("row") % step == step // 2) & (F.col("col") % step == step // 2))
    g = ramp_terms(kind)
    sums = [F.sum(a * b).alias(f"g_{i}_{j}") for i, a in enumerate(g) for j, b in enumerate(g) if j >= i]
    return df.where(F.col(unw) != 0).groupBy("scene").agg(*sums, *[F.sum(a * F.col(unw)).alias(f"y_{i}") for i, a in enumerate(g)])


def solve_ramp(sums, kind: str) -> np.ndarray | None:
    """Coefficients from one row of ramp_sums; null if the system is singular."""
    n = len(ramp_terms(kind))
    g = np.array([[sums[f"g_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    y = np.array([sums[f"y_{i}"] for i in range(n)], float)
    scale = np.sqrt(np.diag(g))
    if (scale < 1e-12).any():
        return None
    unit = g / np.outer(scale, scale)
    if np.linalg.cond(unit) > 1e13:
        return None
    return np.linalg.solve(unit, y / scale) / scale


def apply_ramp(df: DataFrame, kind: str, coef, sign: float, unw: str = "unw", where: str = "_solid") -> DataFrame:
    ramp = sum((F.lit(float(c)) * g for c, g in zip(coef, ramp_terms(kind), strict=True)), F.lit(0.0))
    return df.withColumn(unw, F.when(F.col(where), F.col(unw) + sign * ramp).otherwise(F.col(unw)))


def boundary(labels: DataFrame) -> DataFrame:
    """Labelled pixels with another label (or none) among their eight neighbours."""
    across, down = along("row").rowsBetween(-1, 1), along("col").rowsBetween(-1, 1)
    df = labels.withColumns({"_lo": F.min("label").over(across), "_hi": F.max("label").over(across)})
    df = df.withColumns({"_lo": F.min("_lo").over(down), "_hi": F.max("_hi").over(down)})
    return df.where("label > 0 AND _lo <> _hi").drop("_lo", "_hi")


def sample_boundary(points: DataFrame, cap: int = 4096) -> DataFrame:
    """At most `cap` points of each region, evenly in raster order, numbered from 0."""
    region = Window.partitionBy("scene", "label")
    k = F.row_number().over(region.orderBy("row", "col")) - 1
    stride = F.greatest(F.lit(1), F.call_function("div", F.count("*").over(region), F.lit(cap)))
    points = points.withColumns({"_k": k, "_s": stride}).where(F.col("_k") % F.col("_s") == 0)
    return points.withColumn("local", F.call_function("div", F.col("_k"), F.col("_s")).cast("int")).where(F.col("local") < cap).drop("_k", "_s")


PAIRS = "scene string, li long, lj long, q long, y0 int, x0 int, y1 int, x1 int"


#: Regions of a block: two blocks are one group of nearest_pairs.
BLOCK = 128


def _apart(y: np.ndarray, x: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Squared distance of points to a box."""
    dy, dx = np.maximum(np.maximum(box[0] - y, y - box[1]), 0), np.maximum(np.maximum(box[2] - x, x - box[3]), 0)
    return dy * dy + dx * dx


def _closest(p: tuple, s: tuple) -> tuple[tuple, tuple]:
    """(q, i, j) and (q, j, i) of the closest points of two regions (y, x, box); of equals the first by those."""
    (y0, x0, box0), (y1, x1, box1) = p, s
    # A point farther from the other region's box than some pair, by over 1/64, is in no closest pair.
    to0, to1 = _apart(y0, x0, box1), _apart(y1, x1, box0)
    a, b = to0.argmin(), to1.argmin()
    low = min(((y0 - y1[b]) ** 2 + (x0 - x1[b]) ** 2).min(), ((y0[a] - y1) ** 2 + (x0[a] - x1) ** 2).min())
    limit = (math.sqrt(low) + 1 / 64 + 1e-6) ** 2
    pi, si = np.flatnonzero(to0 <= limit), np.flatnonzero(to1 <= limit)
    best, back, (v, u) = None, None, (y1[si], x1[si])
    for a in range(0, len(pi), 512):  # a few MB at a time
        rows = pi[a : a + 512]
        d = (y0[rows, None] - v) ** 2 + (x0[rows, None] - u) ** 2
        at, to = np.nonzero(d <= (math.sqrt(d.min()) + 1 / 64 + 1e-6) ** 2)
        q = np.floor(np.sqrt(d[at, to].astype(float)) * 64).astype(np.int64)
        low = int(q.min())
        i, j = rows[at[q == low]], si[to[q == low]]  # by i, then j
        k = np.flatnonzero(j == j.min())[0]
        best, back = min(best or (low, i[0], j[0]), (low, i[0], j[0])), min(back or (low, j[k], i[k]), (low, j[k], i[k]))
    return best, back


def _tile(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of regions of two blocks, or of one, in batches."""
    lo, hi = key[1].as_py(), key[2].as_py()
    sides: dict[int, list] = {lo: [], hi: []}
    for b in batches:
        for at, label, points in zip(b.column("_b").to_pylist(), b.column("label").to_pylist(), b.column("points"), strict=True):
            y, x = np.ascontiguousarray(points.values.to_numpy().astype(np.int64).reshape(-1, 2).T)
            sides[at].append((label, (y, x, (y.min(), y.max(), x.min(), x.max()))))
    kinds, out = [*[pa.int64()] * 3, *[pa.int32()] * 4], []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([key[0].as_py()] * len(out), pa.string()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PAIRS.split(", ")])

    for li, p in sides[lo]:
        for lj, s in sides[hi]:
            if lo == hi and li >= lj:
                continue
            (q, i, j), (_, v, u) = _closest(p, s)
            out.append((li, lj, q, p[0][i], p[1][i], s[0][j], s[1][j]))
            out.append((lj, li, q, s[0][v], s[1][v], p[0][u], p[1][u]))
        if len(out) > 20_000:
            yield batch()
    if out:
        yield batch()


def nearest_pairs(points: DataFrame) -> DataFrame:
    """(scene, li, lj, q, y0, x0, y1, x1): the closest sample points of each ordered pair of regions.

    A region is one row with its sample (bounded by the cap).  Blocks of regions
    are dealt out in pairs, so a region is shuffled once for each block and not
    once for each other region; the pairs are made and written in the task.
    """
    sample = F.transform(F.array_sort(F.collect_list(F.struct("local", "row", "col"))), lambda e: F.array(e["row"], e["col"]))
    regions = points.groupBy("scene", "label").agg(F.flatten(sample).alias("points"))
    regions = regions.withColumn("_b", F.floor(F.col("label") / BLOCK).cast("int"))
    blocks = regions.select("scene", "_b").distinct()
    # Each unordered pair of blocks is one group; a region goes to all pairs with its own block.
    pairs = blocks.join(blocks.select("scene", F.col("_b").alias("_o")), "scene").select("scene", "_b", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi")).distinct()
    dealt = regions.join(F.broadcast(pairs), ["scene", "_b"]).select("scene", "lo", "hi", "_b", "label", "points")
    return dealt.groupBy("scene", "lo", "hi").applyInArrow(_tile, PAIRS)


def _near_pairs(points: DataFrame, reach: int) -> DataFrame:
    """(scene, li, lj, there, back), li < lj: the closest points of two regions of different groups with a key of at most 64 `reach`.

    `there` is (q, i, j, y0, x0, y1, x1), the first by (q, i, j); `back` is (q, j, i, y1, x1, y0, x0).  A point
    meets those of the cells round its own, and only where several groups meet.
    """
    cell = lambda c: F.floor(F.col(c) / (reach + 1)).cast("int")
    points = points.withColumns({"_r": cell("row"), "_c": cell("col")})
    beside = F.explode(F.array(*[F.struct((F.col("_r") + i).alias("r"), (F.col("_c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_at")
    around = lambda df, *more: df.select("scene", *more, beside).withColumns({"_r": F.col("_at.r"), "_c": F.col("_at.c")}).drop("_at")
    cells = around(points.select("scene", "_r", "_c", "group").distinct(), "group").groupBy("scene", "_r", "_c").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi"))
    own = points.join(cells.where("_lo < _hi").hint("merge"), ["scene", "_r", "_c"], "left_semi")
    named = lambda df, k, l: df.select("scene", "_r", "_c", F.col("label").alias(f"l{l}"), F.col("group").alias(f"g{l}"), F.col("local").alias(l), F.col("row").alias(f"y{k}"), F.col("col").alias(f"x{k}"))  # noqa: E731, E741
    met = named(own, 0, "i").join(named(around(own, "label", "group", "local", "row", "col"), 1, "j").hint("merge"), ["scene", "_r", "_c"]).where("li < lj AND gi <> gj")
    dy, dx = (F.col(f"{c}0") - F.col(f"{c}1") for c in "yx")
    q = F.floor(F.sqrt((dy * dy + dx * dx).cast("double")) * 64).alias("q")
    met = met.where(dy * dy + dx * dx <= (reach + 1) ** 2).select("scene", "li", "lj", q, "i", "j", "y0", "x0", "y1", "x1").where(F.col("q") <= 64 * reach)
    first = lambda *names: F.min(F.struct(*names))
    return met.groupBy("scene", "li", "lj").agg(first("q", "i", "j", "y0", "x0", "y1", "x1").alias("there"), first("q", "j", "i", "y1", "x1", "y0", "x0").alias("back"))


def tree_pairs(points: DataFrame) -> dict[str, dict[tuple[int, int], tuple]]:
    """For each scene the pairs of regions that a minimum spanning tree may use: (li, lj) and (lj, li) to (q, y0, x0, y1, x1).

    A pair whose regions are joined by strictly closer pairs is in no such tree,
    so pairs are sought within a reach that doubles, between the groups that
    the shorter ones have not joined.  Only the pairs left reach the driver: as
    many as the regions, and those as close as them.
    """
    points = written(points.select("scene", "label", "row", "col", "local"))
    names = points.select("scene", "label").distinct().toArrow().sort_by([("scene", "ascending"), ("label", "ascending")]).to_pydict()
    number = {key: k for k, key in enumerate(zip(names["scene"], names["label"], strict=True))}
    up = list(range(len(number)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out: dict[str, dict[tuple[int, int], tuple]] = {s: {} for s in names["scene"]}
    reach, widest = 2, points.agg(F.coalesce(F.max("row") + F.max("col"), F.lit(0))).first()[0] + 1
    while len({root(k) for k in range(len(up))}) > len(out):
        groups = pa.table({"scene": names["scene"], "label": pa.array(names["label"], pa.int64()), "group": pa.array([root(k) for k in range(len(up))], pa.int64())})
        grouped = points.join(F.broadcast(points.sparkSession.createDataFrame(groups)), ["scene", "label"])
        found = _near_pairs(grouped, reach).toArrow()
        rows = sorted(found.to_pylist(), key=lambda r: r["there"]["q"])
        for _, equal in groupby(rows, key=lambda r: r["there"]["q"]):
            # Judged by the strictly closer ones, joined after: equals may all be used.
            kept = [r for r in equal if root(number[r["scene"], r["li"]]) != root(number[r["scene"], r["lj"]])]
            for r in kept:
                for key, e, flip in (((r["li"], r["lj"]), r["there"], 0), ((r["lj"], r["li"]), r["back"], 1)):
                    ends = (e["y1"], e["x1"], e["y0"], e["x0"]) if flip else (e["y0"], e["x0"], e["y1"], e["x1"])
                    out[r["scene"]][key] = (e["q"], *ends)
                p, q = root(number[r["scene"], r["li"]]), root(number[r["scene"], r["lj"]])
                up[max(p, q)] = min(p, q)
        if reach > widest:
            break
        reach *= 2
    return out


def spanning_tree(pairs: dict[tuple[int, int], int], n: int, root: int) -> list[tuple[int, int]]:
    """(parent, child) edges of the minimum spanning tree from the root, breadth first; lowest label wins ties."""
    near: dict[int, list[tuple[int, int]]] = {}
    for (i, j), d in pairs.items():
        near.setdefault(i, []).append((j, d))
    best: dict[int, tuple[float, int]] = {}
    children: dict[int, list[int]] = {}
    inside, heap, j = {root}, [], root
    while len(inside) <= n:
        for k, d in near.get(j, []):
            if k not in inside and d < best.get(k, (math.inf, 0))[0]:
                best[k] = (d, j)
                heappush(heap, (d, k))
        while heap and heap[0][1] in inside:
            heappop(heap)
        if not heap:
            break
        j = heappop(heap)[1]
        parent = best[j][1]
        inside.add(j)
        children.setdefault(parent, []).append(j)
        children.setdefault(j, []).append(parent)
    order, seen, queue = [], {root}, [root]
    for u in queue:
        for v in children.get(u, []):
            if v not in seen:
                seen.add(v)
                order.append((u, v))
                queue.append(v)
    return order


def region_medians(df: DataFrame, ends: DataFrame, radius: int, unw: str = "unw") -> DataFrame:
    """(scene, label, y, x, median): the upper median of a region in a box round an end of a bridge."""
    # A region meets the ends of its own block of boxes, not all of its ends.
    side = 2 * radius + 1
    block = lambda c: F.floor(c / side).cast("int")
    blocks = lambda c: F.explode(F.sequence(block(F.col(c) - radius), block(F.col(c) + radius)))
    ends = ends.select("scene", "label", "y", "x").withColumn("_r", blocks("y")).withColumn("_c", blocks("x"))
    own = df.where("label > 0").withColumns({"_r": block(F.col("row")), "_c": block(F.col("col"))})
    near = own.join(ends, ["scene", "label", "_r", "_c"]).where((F.abs(F.col("row") - F.col("y")) <= radius) & (F.abs(F.col("col") - F.col("x")) <= radius))
    return near.groupBy("scene", "label", "y", "x").agg(upper_median(F.collect_list(unw)).alias("median"))


def jump(m0: float, m1: float) -> float:
    """Cycles to add to a region whose median is m1 next to one with m0."""
    d = m1 - m0
    n = math.floor((abs(d) + math.pi) / TWO_PI)
    return -n if d > 0 else n


def bridge(df: DataFrame, shape: tuple[int, int], options: BridgeOptions = BridgeOptions(), unw: str = "unw") -> DataFrame:
    """Whole cycles added to regions so that they agree across the gaps; conncomp becomes the region.

    Untouched if at any stage one region or none is left.  Scenes are bridged
    one by one, as their region trees differ.
    """
    spark = df.sparkSession
    df = written(df)
    labels = written(region_labels(df, shape, options.min_num_pixel, unw))

    def regions(x: DataFrame) -> dict[str, int]:
        return {r[0]: r[1] for r in x.groupBy("scene").agg(F.max("label")).collect()}

    several = regions(region_labels(df, shape, 1, unw))
    for circular in (False, True):
        several = {s: n for s, n in several.items() if n > 1 and regions(labels).get(s, 0) > 1}
        labels = written(erode_prune(labels, shape, options.erosion_size, circular))
    live = [s for s, n in regions(labels).items() if n > 1 and s in several]
    if not live:
        return df
    labels, most = labels.where(F.col("scene").isin(live)), regions(labels)
    # Label tables are small on disk and as long as the raster: not to be broadcast.
    joined = written(df.join(labels.hint("merge"), ["scene", "row", "col"]).withColumn("_solid", F.col(unw) != 0))
    reference = {r["scene"]: (r["label"], r["n"]) for r in reference_region(joined).collect()}
    kind, ramps = options.ramp_type, {}
    if kind:
        for scene, (label, _) in reference.items():
            own = joined.where((F.col("scene") == scene) & (F.col("label") == label))
            n = own.where(F.col(unw) != 0).count()
            step = math.ceil(math.sqrt(n / options.ramp_max_num_sample)) if 0 < options.ramp_max_num_sample < n else 1
            row = ramp_sums(own, kind, step, unw).first()
            if row is not None and (coef := solve_ramp(row, kind)) is not None:
                ramps[scene] = coef
    flat = joined
    for scene, coef in ramps.items():
        flat = flat.withColumn("_here", F.col("_solid") & (F.col("scene") == scene))
        flat = apply_ramp(flat, kind, coef, -1.0, unw, "_here").drop("_here")
    found = tree_pairs(sample_boundary(boundary(labels), options.max_boundary_samples))
    edges: list[tuple] = []
    for scene in live:
        near = found[scene]
        for u, v in spanning_tree({k: r[0] for k, r in near.items()}, most[scene], reference[scene][0]):
            edges.append((scene, u, v, *near[u, v][1:]))
    ends = sorted({(s, a, y, x) for s, u, v, y0, x0, y1, x1 in edges for a, y, x in ((u, y0, x0), (v, y1, x1))})
    kinds = {"scene": pa.string(), "label": pa.int64(), "y": pa.int32(), "x": pa.int32()}
    table = spark.createDataFrame(pa.table({name: pa.array([e[k] for e in ends], kind) for k, (name, kind) in enumerate(kinds.items())}))
    middle = region_medians(flat, table, min(options.radius, min(shape) // 2), unw).toArrow().to_pydict()
    medians = dict(zip(zip(*(middle[k] for k in kinds), strict=True), middle["median"], strict=True))
    cycles: dict[tuple[str, int], float] = {}
    for s, u, v, y0, x0, y1, x1 in edges:
        m0, m1 = medians.get((s, u, y0, x0)), medians.get((s, v, y1, x1))
        if m0 is not None and m1 is not None:
            cycles[s, v] = jump(m0 + TWO_PI * cycles.get((s, u), 0.0), m1)
    shifts = spark.createDataFrame([(s, u, float(n)) for (s, u), n in cycles.items()] or [("", 0, 0.0)], "scene string, label long, _n double")
    out = joined.join(shifts, ["scene", "label"], "left").withColumn(unw, F.when(F.col("label") > 0, F.col(unw) + TWO_PI * F.coalesce("_n", F.lit(0.0))).otherwise(F.col(unw)))
    columns = df.columns if "conncomp" in df.columns else [*df.columns, "conncomp"]
    out = out.withColumn("conncomp", F.col("label")).select(*columns)
    rest = df.where(~F.col("scene").isin(live))
    return out.unionByName(rest, allowMissingColumns=True)
