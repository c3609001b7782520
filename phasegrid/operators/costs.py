"""Statistical arc costs and incremental costs.

Arcs are a long table (scene, axis, row, col, ...): axis "col" joins (row, col)
to (row, col + 1), axis "row" joins it to (row + 1, col).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions.phase import COST_LIMIT, NO_PREFERENCE, SHORT_MAX, ceil_div, clamp_short, floor_div, half_even, truncated
from phasegrid.operators.grid import along, azimuth_diff, boxcar, range_diff
from phasegrid.options import CostModel

#: Fixed value: variance of a uniformly distributed phase, in cycles.
UNIFORM_VARIANCE = 2 / 12


def constants(nlooks: float, m: CostModel) -> tuple[float, float]:
    """(coherence threshold, power of the decorrelation) for a number of looks."""
    threshold = m.threshold_factor * (m.rho_a / nlooks + m.rho_b)
    return threshold, 2 * m.c1 + m.c2 * math.log(nlooks) + m.c3 * nlooks


def arc_inputs(pixels: DataFrame, axis: str, shape: tuple[int, int], window: tuple[int, int] = (7, 7)) -> DataFrame:
    """For each arc: its wrapped difference d, local average, mean coherence rho and weight w."""
    nrow, ncol = shape
    line = along("row" if axis == "col" else "col")
    df = pixels if "mask" in pixels.columns else pixels.withColumn("mask", F.lit(True))
    df = df.withColumns({"rho": 0.5 * (F.col("corr") + F.lead("corr").over(line)), "w": F.when(F.col("mask") & F.lead("mask").over(line), 1).otherwise(0)})
    df = (range_diff if axis == "col" else azimuth_diff)(df).select("scene", "row", "col", "d", "rho", "w")
    half = (window[0] // 2, window[1] // 2)
    if axis == "col":
        return boxcar(df.withColumn("average", F.col("d")), "average", (nrow, ncol - 1), half)
    return boxcar(df.withColumn("average", F.col("d")), "average", (nrow - 1, ncol), half[::-1])


def _quantities(nlooks: float, m: CostModel) -> tuple[Column, Column]:
    """(offset, variance) in short cycles, before rounding."""
    threshold, power = constants(nlooks, m)
    rho = F.when(F.col("rho") < threshold, 0.0).otherwise(F.col("rho"))
    # pow as exp(log): both ends of the range, 0 and 1, are exact.
    base = F.lit(1.0) - rho
    decorrelation = F.when(base <= 0, 0.0).otherwise(F.pow(base, F.lit(power)))
    variance = (F.lit(UNIFORM_VARIANCE) * decorrelation + m.sigsq_corr) * float(m.short_cycle**2) / m.scale
    offset = float(m.short_cycle) * (F.col("d") - F.when(rho > 0, F.col("average")).otherwise(0.5 * F.col("average")))
    return offset, variance


def _sigsq(variance: Column, m: CostModel) -> Column:
    return F.least(F.lit(SHORT_MAX), F.greatest(F.lit(m.sigsq_min), truncated(variance, 6)))


def smooth_costs(inputs: DataFrame, axis: str, nlooks: float, model: CostModel = CostModel()) -> DataFrame:
    """(offset, sigsq) of each arc; the offset is truncated."""
    offset, variance = _quantities(nlooks, model)
    masked = F.col("w") == 0
    return inputs.select(
        "scene", F.lit(axis).alias("axis"), "row", "col",
        F.when(masked, NO_PREFERENCE // 2).otherwise(clamp_short(truncated(offset))).cast("short").alias("offset"),
        F.when(masked, NO_PREFERENCE).otherwise(_sigsq(variance, model)).cast("short").alias("sigsq"),
    )


def defo_costs(inputs: DataFrame, axis: str, nlooks: float, model: CostModel = CostModel()) -> DataFrame:
    """(offset, sigsq, dzmax, laycost); the offset is rounded half to even."""
    offset, variance = _quantities(nlooks, model)
    masked = F.col("w") == 0
    dzmax = max(1, min(round(model.short_cycle * model.defo_max), SHORT_MAX))
    sigsq = _sigsq(variance, model)
    laycost = F.least(F.lit(SHORT_MAX), F.floor(F.sqrt((sigsq * dzmax).cast("double"))))
    return inputs.select(
        "scene", F.lit(axis).alias("axis"), "row", "col",
        F.when(masked, NO_PREFERENCE // 2).otherwise(clamp_short(half_even(offset))).cast("short").alias("offset"),
        F.when(masked, NO_PREFERENCE).otherwise(sigsq).cast("short").alias("sigsq"),
        F.when(masked, NO_PREFERENCE).otherwise(dzmax).cast("short").alias("dzmax"),
        F.when(masked, 0).otherwise(laycost).cast("short").alias("laycost"),
    )


def build_costs(pixels: DataFrame, shape: tuple[int, int], nlooks: float, cost: str = "smooth", model: CostModel = CostModel(), window: tuple[int, int] = (7, 7)) -> DataFrame:
    """Costs of all arcs; "topo" takes the deformation form."""
    form = smooth_costs if cost == "smooth" else defo_costs
    return form(arc_inputs(pixels, "row", shape, window), "row", nlooks, model).unionByName(form(arc_inputs(pixels, "col", shape, window), "col", nlooks, model))


def incremental(flow, model: CostModel = CostModel(), step: int = 1, offset="offset", sigsq="sigsq") -> tuple[Column, Column]:
    """(poscost, negcost): cost change of `step` more or less units on an arc with this flow."""
    k = (F.col(flow) if isinstance(flow, str) else flow).cast("long")
    off, s = F.col(offset).cast("long"), F.col(sigsq).cast("long")
    at = lambda f: F.call_function("div", (f * model.short_cycle + off) * (f * model.short_cycle + off), s)
    square = F.lit(step * step).cast("long")

    def cost(delta: int) -> Column:
        raw = at(k + delta) - at(k)
        whole = F.when(raw > 0, ceil_div(raw, square)).otherwise(floor_div(raw, square)) if step != 1 else raw
        return F.when(s == NO_PREFERENCE, F.lit(0)).otherwise(F.greatest(F.lit(-COST_LIMIT), F.least(F.lit(COST_LIMIT), whole))).cast("short")

    return cost(step), cost(-step)


def with_incremental(arcs: DataFrame, flow="flow", model: CostModel = CostModel(), step: int = 1) -> DataFrame:
    pos, neg = incremental(flow, model, step)
    return arcs.withColumns({"poscost": pos, "negcost": neg})


def early_exit(arcs: DataFrame) -> DataFrame:
    """(scene, min_pos, min_neg, optimal): nothing to gain if no unit step lowers the cost."""
    low = arcs.groupBy("scene").agg(F.min("poscost").alias("min_pos"), F.min("negcost").alias("min_neg"))
    return low.withColumn("optimal", (F.col("min_pos") >= 0) & (F.col("min_neg") >= 0))


def initial_weight(model: CostModel = CostModel()) -> Column:
    """Weight of an arc in the initial flow: the cheaper unit step at flow 0, clipped."""
    pos, neg = incremental(F.lit(0), model)
    return F.greatest(F.lit(model.min_cost), F.least(F.lit(model.max_cost), F.least(pos, neg).cast("int"))).cast("short")


def total_cost(arcs: DataFrame, flow: str = "flow", model: CostModel = CostModel()) -> DataFrame:
    """(scene, cost): the objective, arcs without preference left out."""
    z = F.col(flow).cast("long") * model.short_cycle + F.col("offset").cast("long")
    cost = F.when(F.col("sigsq") == NO_PREFERENCE, F.lit(0)).otherwise(F.call_function("div", z * z, F.col("sigsq").cast("long")))
    return arcs.groupBy("scene").agg(F.sum(cost).alias("cost"))
