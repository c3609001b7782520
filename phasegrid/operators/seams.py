"""Neighbour feedback at tile seams, and cycle spikes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import TWO_PI
from phasegrid.operators.graph import written
from phasegrid.operators.tiles import spans

#: Window of the moving median, reach of a measurement, spike tolerance and samples.
SMOOTH, REACH, SPIKE_TOLERANCE, SPIKE_SAMPLES = 21, 42, 0.5, 20


def seam_places(n: int, tiles: int, overlap: int) -> list[int]:
    """First line after each seam that has a line on both sides."""
    return [p for p in (a + overlap // 2 for a, _ in spans(n, tiles, overlap)[1:]) if p - 1 >= 0 and p + 1 < n]


def seam_profile(df: DataFrame, place: int, axis: str = "col", unw: str = "unw") -> DataFrame:
    """(scene, line, diff): the step across a seam on each line, null where a side is invalid.

    axis "col" is a seam between columns; its lines are the rows.
    """
    across, line = ("col", "row") if axis == "col" else ("row", "col")
    near = df.where((F.col(across) == place - 1) | (F.col(across) == place))
    side = lambda at: F.max(F.when((F.col(across) == at) & F.col("mask"), F.col(unw)))
    return near.groupBy("scene", F.col(line).alias("line")).agg((side(place - 1) - side(place)).alias("diff"))


def _seam_of(profile: DataFrame) -> list[str]:
    return [c for c in ("scene", "place") if c in profile.columns]


def seam_profiles(df: DataFrame, places: list[int], axis: str = "col", unw: str = "unw") -> DataFrame:
    """(scene, place, line, diff) of all seams of an axis, from one pass over the pixels beside them."""
    across, line = ("col", "row") if axis == "col" else ("row", "col")
    # A pixel lies beside two seams where a tile has one line of its own.  The places are looked up: a list would be read through for each pixel.
    sides = df.sparkSession.createDataFrame(pa.table({"place": np.repeat(np.array(places, np.int32), 2), "_x": (np.array(places, np.int32)[:, None] - [1, 0]).ravel().astype(np.int32)}))
    near = df.select("scene", F.col(line).alias("line"), F.col(across).alias("_x"), F.when(F.col("mask"), F.col(unw)).alias("_u")).join(F.broadcast(sides), "_x")
    before, after = F.max(F.when(F.col("_x") < F.col("place"), F.col("_u"))), F.max(F.when(F.col("_x") == F.col("place"), F.col("_u")))
    return near.groupBy("scene", "place", "line").agg((before - after).alias("diff"))


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted array; null if it is empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def moving_median(profile: DataFrame, window: int = SMOOTH) -> DataFrame:
    """Each measured step becomes the upper median of those of its seam within the window."""
    w = Window.partitionBy(*_seam_of(profile)).orderBy("line").rowsBetween(-(window // 2), window // 2)
    return profile.withColumn("diff", F.when(F.col("diff").isNotNull(), upper_median(F.collect_list("diff").over(w))))


def fill_gaps(profile: DataFrame, reach: int = REACH) -> DataFrame:
    """Short gaps are interpolated, others fade to zero within `reach` lines; beyond that null."""
    seam = _seam_of(profile)
    back = Window.partitionBy(*seam).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    # The lines ahead are those behind in the opposite order: a frame that ends at the last line is read anew for each line.
    ahead = Window.partitionBy(*seam).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("diff").isNotNull(), F.struct("line", "diff"))
    p = profile.withColumns({"_p": F.last(known, ignorenulls=True).over(back), "_q": F.last(known, ignorenulls=True).over(ahead)})
    i, a, b = F.col("line"), F.col("_p.line"), F.col("_q.line")
    x, y = F.col("_p.diff"), F.col("_q.diff")
    return p.withColumn(
        "diff",
        F.when(F.col("diff").isNotNull(), F.col("diff"))
        .when(b - a <= 2 * reach, x + (i - a) / (b - a) * (y - x))
        .when(i - a <= reach, x * (1.0 - (i - a) / reach))
        .when(b - i <= reach, y * (1.0 - (b - i) / reach)),
    ).drop("_p", "_q")


def seam_apply(df: DataFrame, profile: DataFrame, place: int, feather: int, axis: str = "col", unw: str = "unw") -> DataFrame:
    """Add the filled step, fading over `feather` lines, to the valid pixels after the seam."""
    across, line = ("col", "row") if axis == "col" else ("row", "col")
    x = F.col(across)
    df = df.join(profile.select("scene", F.col("line").alias(line), F.col("diff").alias("_step")), ["scene", line], "left")
    inside = F.col("_step").isNotNull() & F.col("mask") & (x >= place) & (x < place + feather)
    return df.withColumn(unw, F.when(inside, F.col(unw) + F.col("_step") * (1.0 - (x - place) / float(feather))).otherwise(F.col(unw))).drop("_step")


def _share(x: int, place: int, feather: int) -> float:
    """How much of a seam's step a line gets."""
    return 1.0 - (x - place) / float(feather) if place <= x < place + feather else 0.0


def _moved(places: list[int], feather: int) -> dict[int, list[tuple[int, float]]]:
    """For each seam those before it that reach over it, with what a step of theirs adds to its own."""
    first, out = 0, {}
    for n, k in enumerate(places):
        while places[first] + feather < k:
            first += 1
        out[k] = [(j, w) for j in places[first:n] if (w := _share(k - 1, j, feather) - _share(k, j, feather))]
    return out


def _median_of(diff: np.ndarray) -> np.ndarray:
    """moving_median of one seam's lines in order, nan for null."""
    half = SMOOTH // 2
    near = np.sort(np.lib.stride_tricks.sliding_window_view(np.pad(diff, half, constant_values=np.nan), SMOOTH), axis=1)
    n = np.count_nonzero(near == near, axis=1)  # nan is sorted last
    return np.where(diff == diff, near[np.arange(len(diff)), n // 2 * (n > 0)], np.nan)


def _filled_of(line: np.ndarray, diff: np.ndarray, reach: int = REACH) -> np.ndarray:
    """fill_gaps of one seam's lines in order, nan for null."""
    at, known = np.arange(len(diff)), diff == diff
    p, q = np.maximum.accumulate(np.where(known, at, -1)), np.minimum.accumulate(np.where(known, at, len(diff))[::-1])[::-1]
    back, ahead = p >= 0, q < len(diff)
    p, q = np.where(back, p, 0), np.where(ahead, q, 0)
    i, a, b, x, y = line, line[p], line[q], diff[p], diff[q]
    between = x + (i - a) / np.maximum(b - a, 1).astype(float) * (y - x)
    cases = [known, back & ahead & (b - a <= 2 * reach), back & (i - a <= reach), ahead & (b - i <= reach)]
    return np.select(cases, [diff, between, x * (1.0 - (i - a) / float(reach)), y * (1.0 - (b - i) / float(reach))], np.nan)


def _fold_seams(moved: dict[int, list[tuple[int, float]]]):
    """A chain's seams in order; each sees the filled steps of those before it that reach over it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("line", "ascending")])
        place, line = t.column("place").to_numpy(), t.column("line").to_numpy()
        diff = t.column("diff").cast(pa.float64()).fill_null(math.nan).to_numpy().copy()
        cuts = np.flatnonzero(np.diff(place)) + 1
        where = {int(place[a]): slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True)}
        for k, own in where.items():
            for j, w in moved[k]:
                if j in where:
                    at = np.searchsorted(line[where[j]], line[own])
                    same = at < len(line[where[j]])
                    same[same] = line[where[j]][at[same]] == line[own][same]
                    step = np.zeros(len(at))
                    step[same] = np.nan_to_num(diff[where[j]][at[same]])
                    diff[own] += w * step
            diff[own] = _filled_of(line[own], _median_of(diff[own]))
        return pa.table({"scene": t.column("scene"), "place": t.column("place"), "line": t.column("line"), "diff": pa.array(diff, from_pandas=True)})

    return run


def seam_steps(df: DataFrame, places: list[int], feather: int, axis: str = "col", unw: str = "unw") -> DataFrame:
    """(scene, place, line, diff): the filled step of every seam, each measured on what the ones before changed.

    The pixels are read once.  Where no seam lies within the feather of another,
    all seams are one table keyed by seam.  Else a scene's chain of seams that
    reach over the next is one group, worked through in order: a number for each
    line of a seam, so no more than the pixels over the lines between seams.
    """
    profiles, moved = seam_profiles(df, places, axis, unw), _moved(places, feather)
    if not any(moved.values()):
        return fill_gaps(moving_median(profiles))
    heads = np.array([k for k in places if not moved[k]], np.int32)
    chain = np.searchsorted(heads, np.array(places), "right").astype(np.int32)
    chains = df.sparkSession.createDataFrame(pa.table({"place": np.array(places, np.int32), "_chain": chain}))
    rows = profiles.select("scene", F.col("place").cast("int").alias("place"), F.col("line").cast("int").alias("line"), F.col("diff").cast("double").alias("diff"))
    return rows.join(F.broadcast(chains), "place").groupBy("scene", "_chain").applyInArrow(lambda t: _fold_seams(moved)(t), "scene string, place int, line int, diff double")


def seams_apply(df: DataFrame, steps: DataFrame, feather: int, axis: str = "col", unw: str = "unw") -> DataFrame:
    """Add the filled steps of all seams of an axis, in the order of the seams: one join by line and stretch.

    A stretch has as many lines as the feather, so a seam reaches two of them and
    a pixel meets only the seams of its own and the stretch before.
    """
    across, line = ("col", "row") if axis == "col" else ("row", "col")
    x = F.col(across)
    stretch = lambda c: F.call_function("div", c.cast("long"), F.lit(feather).cast("long"))
    two = F.explode(F.array(stretch(F.col("place")), stretch(F.col("place")) + 1)).alias("_at")
    reached = steps.where("diff is not null").select("scene", F.col("line").alias(line), "place", "diff", two)
    found = reached.groupBy("scene", line, "_at").agg(F.array_sort(F.collect_list(F.struct("place", "diff"))).alias("_steps"))

    def add(total: Column, e: Column) -> Column:
        inside = (x >= e["place"]) & (x < e["place"] + feather)
        return F.when(inside, total + e["diff"] * (1.0 - (x - e["place"]) / float(feather))).otherwise(total)

    new = F.aggregate("_steps", F.col(unw).cast("double"), add)
    df = df.withColumn("_at", stretch(x)).join(found, ["scene", line, "_at"], "left")
    return df.withColumn(unw, F.when(F.col("mask") & F.col("_steps").isNotNull(), new).otherwise(F.col(unw))).drop("_steps", "_at")


def neighbour_feedback(df: DataFrame, shape: tuple[int, int], ntiles: tuple[int, int], overlap: tuple[int, int], feather: int = 200, unw: str = "unw") -> DataFrame:
    """All column seams in order, then all row seams; each sees what the ones before changed."""
    if feather <= 0:
        return df
    df = df if "mask" in df.columns else df.withColumn("mask", F.lit(True))
    for axis, k in (("col", 1), ("row", 0)):
        if places := seam_places(shape[k], ntiles[k], overlap[k]):
            # Written: the other axis reads the result twice, to measure and to correct it.
            df = written(seams_apply(df, seam_steps(df, places, feather, axis, unw), feather, axis, unw))
    return df


def line_medians(df: DataFrame, axis: str = "row", unw: str = "unw") -> DataFrame:
    """(scene, line, median): the upper median of each line's valid pixels, null under 21 of them."""
    value = F.when(F.col("mask"), F.col(unw))
    found = F.collect_list(value)
    return df.groupBy("scene", F.col(axis).alias("line")).agg(F.when(F.count(value) > SPIKE_SAMPLES, upper_median(found)).alias("median"))


def _fold(t: pa.Table) -> pa.Table:
    """A scene's lines in order; a corrected line counts as corrected for the next."""
    t = t.sort_by("line")
    lines, m = t.column("line").to_pylist(), [math.nan if x is None else x for x in t.column("median").to_pylist()]
    out: list[tuple[int, float]] = []
    last = m[0]
    for k in range(1, len(m) - 1):
        up, down = m[k] - last, m[k] - m[k + 1]
        n, other = (math.copysign(math.floor(abs(d) / TWO_PI + 0.5), d) if d == d else math.nan for d in (up, down))
        hit = n != 0 and n == other and abs(up - n * TWO_PI) <= SPIKE_TOLERANCE and abs(down - n * TWO_PI) <= SPIKE_TOLERANCE
        last = m[k] - (n * TWO_PI if hit else 0.0)
        if hit:
            out.append((lines[k], n))
    scene = pa.array([t.column("scene")[0].as_py()] * len(out), pa.string())
    return pa.table({"scene": scene, "line": pa.array([x for x, _ in out], pa.int32()), "cycles": pa.array([n for _, n in out], pa.float64())})


def spike_cycles(medians: DataFrame) -> DataFrame:
    """(scene, line, cycles) of the lines that jump by whole cycles and back: one number a line, folded in order."""
    lines = medians.select("scene", F.col("line").cast("int").alias("line"), F.col("median").cast("double").alias("median"))
    return lines.groupBy("scene").applyInArrow(_fold, "scene string, line int, cycles double")


def fix_spikes_along(df: DataFrame, axis: str = "row", unw: str = "unw") -> DataFrame:
    found = spike_cycles(line_medians(df, axis, unw)).select("scene", F.col("line").alias(axis), F.col("cycles").alias("_n"))
    df = df.join(found, ["scene", axis], "left")
    return df.withColumn(unw, F.when(F.col("mask") & F.col("_n").isNotNull(), F.col(unw) - F.col("_n") * TWO_PI).otherwise(F.col(unw))).drop("_n")


def fix_cycle_spikes(df: DataFrame, unw: str = "unw") -> DataFrame:
    """Rows that jump by whole cycles and back, then columns on the result."""
    df = df if "mask" in df.columns else df.withColumn("mask", F.lit(True))
    return fix_spikes_along(fix_spikes_along(df, "row", unw), "col", unw)


def reference_shift(df: DataFrame, pixel: tuple[int, int] = (0, 0), unw: str = "unw", phase: str = "psi") -> DataFrame:
    """Whole cycles off everywhere so that the pixel has its wrapped phase."""
    at = df.where((F.col("row") == pixel[0]) & (F.col("col") == pixel[1]))
    n = at.select("scene", F.rint((F.col(unw) - F.col(phase)) / TWO_PI).alias("_n"))  # one row a scene
    return df.join(n, "scene").withColumn(unw, F.col(unw) - F.col("_n") * TWO_PI).drop("_n")
