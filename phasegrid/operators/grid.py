"""Neighbour differences, mirror padding, moving averages, masks.

Along a row the partition is (scene, row), along a column (scene, col): each
axis costs one exchange, and everything along it shares that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import TWO_PI, wrap_cycles


def along(axis: str):
    """Window along a line of the given axis: "row" runs through the columns."""
    fixed, moving = ("row", "col") if axis == "row" else ("col", "row")
    return Window.partitionBy("scene", fixed).orderBy(moving)


def upto(axis: str, reverse: bool = False):
    """Running window from the first pixel of a line, or from its last, to this one."""
    fixed, moving = ("row", "col") if axis == "row" else ("col", "row")
    return Window.partitionBy("scene", fixed).orderBy(F.desc(moving) if reverse else F.asc(moving)).rowsBetween(Window.unboundedPreceding, 0)


def clean(df: DataFrame) -> DataFrame:
    """Non-finite complex values and coherences become 0; a missing mask is all valid."""
    bad = lambda c: F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf"))
    if {"re", "im"} <= set(df.columns):
        either = bad("re") | bad("im")
        df = df.withColumns({c: F.when(either, F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in ("re", "im")})
    if "corr" in df.columns:
        df = df.withColumn("corr", F.when(bad("corr"), F.lit(0.0)).otherwise(F.col("corr").cast("double")))
    mask = F.coalesce(F.col("mask").cast("int"), F.lit(0)) != 0 if "mask" in df.columns else F.lit(True)
    return df.withColumn("mask", mask)


def masked_magnitude(mag: str | Column = "mag", mask: str | Column = "mask") -> Column:
    """Magnitude, 1 where there is none, 0 where the mask is."""
    mag, mask = (F.col(x) if isinstance(x, str) else x for x in (mag, mask))
    return F.when(mask, F.coalesce(mag.cast("double"), F.lit(1.0))).otherwise(0.0)


def coherent(df: DataFrame, floor: float = 0.05) -> DataFrame:
    """Pixels with usable coherence."""
    return df.where(F.col("corr") >= floor)


def restore_mask(df: DataFrame, label: str = "conncomp", mask: str = "mask") -> DataFrame:
    """Labels only where the original mask is valid."""
    return df.withColumn(label, F.when(F.col(mask), F.col(label)).otherwise(0))


def range_diff(df: DataFrame, phase: str = "psi") -> DataFrame:
    """Wrapped difference to the right neighbour in cycles, one row less a line."""
    d = (F.lead(phase).over(along("row")) - F.col(phase)) / TWO_PI
    return df.withColumn("d", wrap_cycles(d)).where("d is not null")


def azimuth_diff(df: DataFrame, phase: str = "psi") -> DataFrame:
    """Wrapped difference of a pixel less the one below, in cycles."""
    d = (F.col(phase) - F.lead(phase).over(along("col"))) / TWO_PI
    return df.withColumn("d", wrap_cycles(d)).where("d is not null")


def mirror_pad(df: DataFrame, moving: str, n: int, k: int) -> DataFrame:
    """Reflected copies of the k lines next to each edge (edge lines not repeated)."""
    if k >= n:
        raise ValueError(f"a half width of {k} needs more than {k} lines, got {n}")
    x = F.col(moving)
    places = F.array(x, F.when((x >= 1) & (x <= k), -x), F.when((x >= n - 1 - k) & (x <= n - 2), 2 * (n - 1) - x))
    return df.withColumn(moving, F.explode(F.array_compact(places)))


def _average(df: DataFrame, value: str, axis: str, n: int, k: int) -> DataFrame:
    moving = "col" if axis == "row" else "row"
    mean = F.avg(value).over(along(axis).rowsBetween(-k, k))
    return mirror_pad(df, moving, n, k).withColumn(value, mean).where((F.col(moving) >= 0) & (F.col(moving) < n))


def boxcar(df: DataFrame, value: str, shape: tuple[int, int], half: tuple[int, int]) -> DataFrame:
    """Moving average over (2 half + 1) rows and columns, mirror-padded: along rows, then columns."""
    return _average(_average(df, value, "row", shape[1], half[1]), value, "col", shape[0], half[0])


def dilate(df: DataFrame, pixels: int, mask: str = "mask") -> DataFrame:
    """Grow the mask by `pixels` steps of 4-connectivity: Manhattan distance, two running minima an axis."""
    if pixels < 0:
        raise ValueError("pixels must be >= 0")
    far = F.lit(1 << 30)
    # Minima from the far end are running ones in the opposite order: a frame that ends at the last row is read anew for each row.
    left = F.col("col") - F.max(F.when(F.col(mask), F.col("col"))).over(upto("row"))
    right = F.min(F.when(F.col(mask), F.col("col"))).over(upto("row", True)) - F.col("col")
    df = df.withColumn("_d", F.least(F.coalesce(left, far), F.coalesce(right, far)))
    d = F.least(F.min(F.col("_d") - F.col("row")).over(upto("col")) + F.col("row"), F.min(F.col("_d") + F.col("row")).over(upto("col", True)) - F.col("row"))
    return df.withColumn(mask, d <= pixels).drop("_d")


def arc_masks(df: DataFrame, axis: str, mask: str = "mask") -> Column:
    """1 if both ends of the arc are valid, else 0."""
    return F.when(F.col(mask) & F.lead(mask).over(along(axis)), 1).otherwise(0)
