"""Residues, seeded flows and phase integration.

Sign of a flow k: to the right, the unwrapped step is the wrapped one plus
2 pi k; downwards it is the wrapped one less 2 pi k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import TWO_PI, arc_endpoints, wrap_cycles, wrap_signed
from phasegrid.operators.grid import along
from phasegrid.options import CostModel


def residues(df: DataFrame, phase: str = "psi") -> DataFrame:
    """Integer curl of the wrapped differences round each 2 x 2 loop."""
    across, down = along("row"), along("col")
    df = df.withColumns({
        "_c": wrap_cycles((F.lead(phase).over(across) - F.col(phase)) / TWO_PI),
        "_r": wrap_cycles((F.col(phase) - F.lead(phase).over(down)) / TWO_PI),
    })
    df = df.withColumns({"_c1": F.lead("_c").over(down), "_r1": F.lead("_r").over(across)})
    curl = F.rint(F.col("_c") - F.col("_r1") - F.col("_c1") + F.col("_r"))
    return df.where("_c1 is not null and _r1 is not null").select("scene", "row", "col", curl.cast("byte").alias("residue"))


def seeded_flows(df: DataFrame, unw: str = "unw", phase: str = "psi") -> DataFrame:
    """The flow of each arc that an unwrapped raster implies: (scene, axis, row, col, flow)."""

    def one(axis: str, line: str, sign: int) -> DataFrame:
        w = along(line)
        step = F.lead(unw).over(w) - F.col(unw)
        k = F.rint((step - wrap_signed(F.lead(phase).over(w) - F.col(phase))) / TWO_PI) * sign
        return df.select("scene", F.lit(axis).alias("axis"), "row", "col", k.cast("short").alias("flow")).where("flow is not null")

    return one("row", "col", -1).unionByName(one("col", "row", 1))


def integrate(df: DataFrame, row_flow: str = "krow", col_flow: str = "kcol", phase: str = "psi") -> DataFrame:
    """Unwrapped phase by prefix sums: down the first column, then along each row."""
    down = Window.partitionBy("scene").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("scene", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_row = Window.partitionBy("scene").orderBy("row")
    first = df.where("col = 0").select("scene", "row", phase, row_flow)
    step = wrap_signed(F.col(phase) - F.lag(phase).over(by_row)) - TWO_PI * F.lag(row_flow).over(by_row)
    first = first.withColumn("_step", F.coalesce(step, F.col(phase)))
    first = first.select("scene", "row", F.sum("_step").over(down).alias("_base"))
    step = wrap_signed(F.col(phase) - F.lag(phase).over(along("row"))) + TWO_PI * F.lag(col_flow).over(along("row"))
    df = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    df = df.withColumn("_off", F.sum("_step").over(across))
    return df.join(first, ["scene", "row"]).withColumn("unw", F.col("_base") + F.col("_off")).drop("_step", "_off", "_base")


def arc_flows_wide(flows: DataFrame) -> DataFrame:
    """(scene, row, col, krow, kcol) from the long table."""
    at = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("flow"))), F.lit(0))
    return flows.groupBy("scene", "row", "col").agg(at("row").alias("krow"), at("col").alias("kcol"))


def residual_edges(arcs: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Directed edges of the residue network with their costs: (scene, src, dst, cost, axis, row, col, sign)."""
    tail, head = arc_endpoints("axis", "row", "col", *shape)
    both = F.explode(F.array(F.struct(tail.alias("src"), head.alias("dst"), F.col("poscost").cast("int").alias("cost"), F.lit(1).alias("sign")), F.struct(head.alias("src"), tail.alias("dst"), F.col("negcost").cast("int").alias("cost"), F.lit(-1).alias("sign"))))
    return arcs.select("scene", "axis", "row", "col", both.alias("e")).where("e.src is not null").select("scene", "e.src", "e.dst", "e.cost", "axis", "row", "col", "e.sign")


def relax(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """One Bellman-Ford round: (scene, node, dist, via, improved); of equal distances the lowest source wins.

    Both joins are by shuffles: there are as many nodes as loops, whatever the planner takes their table's size to be.
    """
    reach = edges.join(dist.select("scene", F.col("node").alias("src"), "dist").hint("merge"), ["scene", "src"])
    best = reach.groupBy("scene", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("cost")).alias("d"), F.col("src").alias("s"))).alias("b"))
    new = dist.join(best.hint("merge"), ["scene", "node"], "left")
    better = F.coalesce(F.col("b.d") < F.col("dist"), F.lit(False))
    return new.select("scene", "node", F.when(better, F.col("b.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("b.s")).alias("via"), better.alias("improved"))


def network_nodes(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Start of the relaxation: every node and the ground at distance 0."""
    n = (shape[0] - 1) * (shape[1] - 1)
    nodes = df.sparkSession.range(n + 1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("dist"))
    return nodes.crossJoin(F.broadcast(df.select("scene").distinct())).select("scene", "node", "dist")


def cancel_cycles(arcs: DataFrame, shape: tuple[int, int], model: CostModel = CostModel(), flow: str = "flow") -> DataFrame:
    """The arcs with flows after cancelling every negative unit cycle, scene by scene."""
    from phasegrid.solvers.tiles import refine_flows

    return refine_flows(arcs, shape, model, flow)
