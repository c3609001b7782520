"""Connected components of a raster.

Runs of connected pixels along a row are found by a window, so the graph that
is iterated has a node for each run and not for each pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators.graph import components, written
from phasegrid.operators.grid import along


def _lines(df: DataFrame, ncol: int, valid: Column, near: Column) -> DataFrame:
    """Pixels with the run that they are in: the flat index of its first pixel."""
    w = along("row")
    df = df.withColumn("_valid", valid)
    joined = F.coalesce(F.col("_valid") & F.lag("_valid").over(w) & near, F.lit(False))
    flat = F.col("row").cast("long") * ncol + F.col("col")
    start = F.when(F.col("_valid") & ~joined, flat)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_start", start).withColumn("run", F.when(F.col("_valid"), F.last("_start", ignorenulls=True).over(upto))).drop("_start")


def label_runs(df: DataFrame, shape: tuple[int, int], valid: Column, step: str | None = None, diagonal: bool = False, open_row: Column | None = None, open_col: Column | None = None) -> DataFrame:
    """(scene, row, col, root): the smallest flat index of the pixel's component, null if invalid.

    Neighbours join if both are valid, their `step` differs by less than pi
    (where given) and the arc between them is open (columns of the upper or
    left pixel).  `diagonal` joins all eight neighbours.
    """
    ncol = shape[1]
    w, v = along("row"), along("col")
    near = F.abs(F.col(step) - F.lag(step).over(w)) < math.pi if step else F.lit(True)
    if open_col is not None:
        near = near & F.lag(open_col).over(w)
    df = _lines(df, ncol, valid, near)
    below = F.col("_valid") & F.lead("_valid").over(v)
    if step:
        below = below & (F.abs(F.col(step) - F.lead(step).over(v)) < math.pi)
    if open_row is not None:
        below = below & open_row
    df = df.withColumns({"_next": F.lead("run").over(v), "_below": F.coalesce(below, F.lit(False))})
    # Scenes are kept apart by their number in the high bits of a node.
    scenes = df.select("scene").distinct().withColumn("_scene", F.row_number().over(Window.orderBy("scene")).cast("long"))
    # Written: the graph and its answer both read the runs, which would be made twice.
    df = written(df.join(F.broadcast(scenes), "scene").select("scene", "row", "col", "_scene", "_valid", "run", "_next", "_below"))
    node = lambda c: F.shiftleft("_scene", 41) + F.col(c)
    pairs = df.where("_below").select(node("run").alias("a"), node("_next").alias("b"))
    if diagonal:
        aside = df.withColumns({"_l": F.lag("_next").over(w), "_r": F.lead("_next").over(w)}).where("_valid")
        pairs = pairs.union(aside.where("_l is not null").select(node("run"), node("_l"))).union(aside.where("_r is not null").select(node("run"), node("_r")))
    found = components(pairs.distinct())
    df = df.withColumn("_node", node("run"))
    out = df.join(found.hint("merge"), df["_node"] == found["node"], "left")
    root = F.coalesce(F.col("root").bitwiseAND((1 << 41) - 1), F.col("run"))
    return out.select("scene", "row", "col", F.when(F.col("_valid"), root).alias("root"))


def compact(labels: DataFrame, shape: tuple[int, int] | None, min_frac: float = 0.01, max_ncomps: int = 32, min_size: int | None = None) -> DataFrame:
    """conncomp 1, 2, ... in the order of the roots: components of enough pixels, the first `max_ncomps`.

    Without a shape the scene's own number of pixels counts.
    """
    sizes = labels.where("root is not null").groupBy("scene", "root").count()
    if min_size is not None or shape is not None:
        sizes = sizes.where(F.col("count") >= (max(1, int(min_frac * shape[0] * shape[1])) if min_size is None else min_size))
    else:
        sizes = sizes.join(labels.groupBy("scene").agg(F.count("*").alias("_all")), "scene").where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("_all") * min_frac)))
    number = F.row_number().over(Window.partitionBy("scene").orderBy("root"))
    table = sizes.withColumn("conncomp", number).where(F.col("conncomp") <= max_ncomps).select("scene", "root", "conncomp")
    return labels.join(table, ["scene", "root"], "left").select("scene", "row", "col", F.coalesce("conncomp", F.lit(0)).cast("long").alias("conncomp"))


def regrow(df: DataFrame, shape: tuple[int, int], cost_thresh: float = 0.1, min_conncomp_frac: float = 0.01, max_ncomps: int = 32, unw: str = "unw") -> DataFrame:
    """Components of an unwrapped raster: coherence and mask make pixels valid, steps under pi join them."""
    valid = F.col("corr") >= cost_thresh
    if "mask" in df.columns:
        valid = valid & F.col("mask")
    return compact(label_runs(df, shape, F.coalesce(valid, F.lit(False)), unw), shape, min_conncomp_frac, max_ncomps)


def confidence(df: DataFrame, shape: tuple[int, int], arcs: DataFrame | None = None, threshold: int = 300, min_conncomp_frac: float = 0.01, max_ncomps: int = 32, unw: str = "unw", floor: float = 0.05) -> DataFrame:
    """Components of a solution: as regrow with a fixed floor, and arcs whose cheaper unit step costs enough."""
    valid = (F.col("corr") >= floor) & (F.col("mask") if "mask" in df.columns else F.lit(True))
    open_row = open_col = None
    if arcs is not None:
        sure = F.least("poscost", "negcost") >= threshold
        wide = arcs.groupBy("scene", "row", "col").agg(F.bool_or(F.when(F.col("axis") == "row", sure)).alias("_or"), F.bool_or(F.when(F.col("axis") == "col", sure)).alias("_oc"))
        df = df.join(wide.hint("merge"), ["scene", "row", "col"], "left")  # as many arcs as pixels: nothing to broadcast
        open_row, open_col = F.coalesce("_or", F.lit(False)), F.coalesce("_oc", F.lit(False))
    labels = label_runs(df, shape, F.coalesce(valid, F.lit(False)), unw, False, open_row, open_col)
    return compact(labels, None, min_conncomp_frac, max_ncomps)
