"""The whole unwrapping: declarative stages round one grouped solver."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.phase import wrapped_phase
from phasegrid.operators import components, costs, flow, grid, seams, tiles
from phasegrid.operators.bridge import bridge
from phasegrid.operators.graph import written
from phasegrid.options import UnwrapOptions, check_complex, check_float, check_grid, check_mask
from phasegrid.solvers.tiles import refine_flows, solve_tiles


def cluster_info(spark: SparkSession) -> dict:
    """What the work runs on: there is no device to choose, only executors."""
    sc = spark.sparkContext
    return {"name": sc.master, "count": sc.defaultParallelism, "version": sc.version, "executor_memory": sc.getConf().get("spark.executor.memory", "1g")}


def _with_arc_costs(df: DataFrame, arcs: DataFrame) -> DataFrame:
    """Pixels with the costs of the arcs that start at them."""
    kinds = [c for c in ("offset", "sigsq", "dzmax", "laycost") if c in arcs.columns]
    pick = lambda axis, name: F.max(F.when(F.col("axis") == axis, F.col(name))).alias(f"{name}_{axis[0]}")
    wide = arcs.groupBy("scene", "row", "col").agg(*(pick(axis, k) for k in kinds for axis in ("row", "col")))
    return df.join(wide, ["scene", "row", "col"], "left")


def _label_tiles(solved: DataFrame, arcs: DataFrame | None, shape: tuple[int, int], o: UnwrapOptions) -> DataFrame:
    """conncomp of each tile on its own: the tile is the scene of the component operators."""
    key = F.concat_ws("/", "scene", "tr", "tc")
    own = solved.withColumns({"_scene": F.col("scene"), "scene": key})
    at_flow = None
    if arcs is not None:
        k = flow.seeded_flows(own.select("scene", "row", "col", "unw", "psi"))
        named = own.select("scene", "_scene", "row", "col")
        k = k.join(named, ["scene", "row", "col"]).join(arcs.withColumnRenamed("scene", "_scene"), ["_scene", "axis", "row", "col"])
        at_flow = costs.with_incremental(k, "flow", o.model)
    labels = components.confidence(own.select("scene", "row", "col", "unw", "corr", "mask"), shape, at_flow, o.model.component_cost, o.min_conncomp_frac, o.max_ncomps)
    return own.join(labels, ["scene", "row", "col"]).drop("scene").withColumnRenamed("_scene", "scene")


def unwrap(pixels: DataFrame, shape: tuple[int, int], options: UnwrapOptions) -> DataFrame:
    """(scene, row, col, unw, conncomp) of (scene, row, col, re, im, corr [, mask, mag]).

    Order: costs, tile solves, components, offsets and merge, neighbour
    feedback, re-optimisation, spikes, bridging, original mask, reference pixel.
    A scene of one tile takes no part in feedback, re-optimisation and spikes.
    """
    check_complex(pixels)
    check_float(pixels, "corr", *[c for c in ("mag",) if c in pixels.columns])
    if "mask" in pixels.columns:
        check_mask(pixels, "mask")
    check_grid(pixels, shape)
    o = options.resolved(shape)
    padded = "mask" in pixels.columns and o.mask_pad_distance > 0
    df = grid.clean(pixels)
    df = df.select("scene", "row", "col", wrapped_phase("re", "im").alias("psi"), "corr", "mask", F.col("mask").alias("conf"), F.col("mag") if "mag" in df.columns else F.lit(1.0).alias("mag"))
    if padded:
        df = grid.dilate(df, o.mask_pad_distance)
    # Loops without any magnitude round them keep the flows of the start.
    df = written(df.withColumn("mag", grid.masked_magnitude()))
    arcs = written(costs.build_costs(df, shape, o.nlooks, o.cost, o.model, o.phase_grad_window))
    many = max(o.ntiles) > 1
    parts = tiles.split(_with_arc_costs(df, arcs), shape, o.ntiles, o.tile_overlap)
    solved = solve_tiles(parts, o.init, o.model, o.laplace, o.early_exit)
    solved = written(solved.join(df.drop("mag"), ["scene", "row", "col"]))
    # Only smooth network solutions have incremental costs to judge arcs by.
    judged = arcs if o.cost == "smooth" and o.init != "laplace" else None
    solved = written(_label_tiles(solved, judged, shape, o))
    if many:
        offsets = None
        if max(o.tile_overlap) > 0:
            sides = [tiles.neighbour_offsets(solved, shape, o.ntiles, o.tile_overlap, axis, o.init == "laplace") for axis in ("horizontal", "vertical")]
            offsets = tiles.tile_offsets(*sides, solved)
        out = written(tiles.merge(solved, shape, o.ntiles, o.tile_overlap, offsets))
        feedback = o.neighbor_feedback and not o.single_tile_reoptimize and o.init == "laplace"
        if feedback and not padded:
            out = written(seams.neighbour_feedback(out, shape, o.ntiles, o.tile_overlap, o.neighbor_feedback_feather))
        if o.single_tile_reoptimize:
            out = written(reoptimize(out, arcs, shape, o))
        if o.fix_cycle_spikes:
            out = written(seams.fix_cycle_spikes(out))
    else:
        feedback, out = False, solved.drop("tr", "tc")
    if o.bridge:
        out = written(bridge(out, shape, o.bridge))
    if feedback and padded:
        own = out.withColumns({"_solved": F.col("mask"), "mask": F.col("conf")})
        out = written(seams.neighbour_feedback(own, shape, o.ntiles, o.tile_overlap, o.neighbor_feedback_feather).drop("_solved"))
    if padded:
        out = grid.restore_mask(out, "conncomp", "conf")
    if o.reference_pixel is not None:
        out = seams.reference_shift(out, o.reference_pixel)
    return out.select("scene", "row", "col", F.col("unw").cast("float").alias("unw"), F.col("conncomp").cast("long").alias("conncomp"))


def reoptimize(out: DataFrame, arcs: DataFrame, shape: tuple[int, int], o: UnwrapOptions) -> DataFrame:
    """The whole scene as one tile, from the flows that the merged result implies; components anew."""
    k = flow.seeded_flows(out.select("scene", "row", "col", "unw", "psi"))
    better = written(refine_flows(arcs.join(k, ["scene", "axis", "row", "col"]), shape, o.model))
    own = out.drop("unw", "conncomp")
    wide = own.join(flow.arc_flows_wide(better), ["scene", "row", "col"], "left").fillna(0, ["krow", "kcol"])
    again = written(flow.integrate(wide).drop("krow", "kcol"))
    judged = costs.with_incremental(arcs.join(better, ["scene", "axis", "row", "col"]), "flow", o.model) if o.cost == "smooth" else None
    labels = components.confidence(again, shape, judged, o.model.component_cost, o.min_conncomp_frac, o.max_ncomps)
    return again.join(labels, ["scene", "row", "col"])


def unwrap_arrays(spark: SparkSession, igram, corr, nlooks: float, mask=None, mag=None, unw=None, conncomp=None, **options):
    """Arrays in, arrays out; `unw` and `conncomp` are filled in place where given."""
    import numpy as np

    from phasegrid.sources import from_arrays, to_arrays

    planes = {"igram": np.asarray(igram), "corr": np.asarray(corr)}
    if not np.iscomplexobj(planes["igram"]):
        raise TypeError(f"igram must be complex, got dtype={planes['igram'].dtype}")
    for name, plane in (("mask", mask), ("mag", mag)):
        if plane is not None:
            plane = np.asarray(plane)
            if name == "mask" and plane.dtype not in (np.bool_, np.uint8, np.int8):
                raise TypeError(f"mask must be bool or 8-bit integer, got dtype={plane.dtype}")
            planes[name] = plane != 0 if name == "mask" else plane
    df = from_arrays(spark, **planes)
    shape = planes["corr"].shape
    found = to_arrays(unwrap(df, shape, UnwrapOptions(nlooks, **options)), shape, "unw", "conncomp", out={"unw": unw, "conncomp": conncomp})
    return found["unw"], found["conncomp"]


def with_options(options: UnwrapOptions, **changes) -> UnwrapOptions:
    return replace(options, **changes)
