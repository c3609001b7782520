"""Scalar phase arithmetic as column expressions (all stay JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Fixed values of the cost model: no preference, and the most a cost may be.
NO_PREFERENCE, COST_LIMIT = 32000, 32000
SHORT_MIN, SHORT_MAX = -32768, 32767


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def wrapped_phase(re, im) -> Column:
    """Phase of a complex number in [0, 2 pi)."""
    a = F.atan2(_col(im), _col(re))
    return F.when(a < 0, a + TWO_PI).otherwise(a)


def wrap_positive(x) -> Column:
    """x modulo 2 pi, in [0, 2 pi)."""
    x = _col(x)
    return x - TWO_PI * F.floor(x / TWO_PI)


def wrap_cycles(d) -> Column:
    """Cycles modulo one, in [-0.5, 0.5)."""
    d = _col(d)
    return d - F.floor(d + 0.5)


def wrap_signed(x) -> Column:
    """x less the nearest whole cycles (ties to even), in [-pi, pi]."""
    x = _col(x)
    return x - TWO_PI * F.rint(x / TWO_PI)


def truncated(x, digits: int = 9) -> Column:
    """Towards zero, after rounding away the last bits that engines disagree on."""
    return F.round(_col(x), digits).cast("long")


def half_even(x, digits: int = 9) -> Column:
    return F.rint(F.round(_col(x), digits)).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    """Whole quotient towards minus infinity, b > 0."""
    q = F.call_function("div", a, b)
    return F.when((a < 0) & (q * b != a), q - 1).otherwise(q)


def ceil_div(a: Column, b: Column) -> Column:
    """Whole quotient towards plus infinity, b > 0."""
    q = F.call_function("div", a, b)
    return F.when((a > 0) & (q * b != a), q + 1).otherwise(q)


def clamp_short(x: Column) -> Column:
    return F.greatest(F.lit(SHORT_MIN), F.least(F.lit(SHORT_MAX), x))


def arc_weight(sigsq) -> Column:
    """Weight of an arc in least squares: 1 / variance, 0 without preference."""
    s = _col(sigsq)
    return F.when((s > 0) & (s < NO_PREFERENCE), F.lit(1.0) / s).otherwise(0.0)


def congruent(u, phase) -> Column:
    """The value nearest to u that differs from phase by whole cycles."""
    u, phase = _col(u), _col(phase)
    return phase + TWO_PI * F.rint((u - phase) / TWO_PI)


def arc_index(direction, row, col, nrow: int, ncol: int) -> Column:
    """Flat index of a pixel's arc: 0 up, 1 down, 2 left, 3 right; null off the grid."""
    d, r, c = _col(direction), _col(row).cast("long"), _col(col).cast("long")
    side = F.lit((nrow - 1) * ncol) + r * (ncol - 1) + c
    return (
        F.when((d == 0) & (r > 0), (r - 1) * ncol + c)
        .when((d == 1) & (r < nrow - 1), r * ncol + c)
        .when((d == 2) & (c > 0), side - 1)
        .when((d == 3) & (c < ncol - 1), side)
    )


def arc_endpoints(axis, row, col, nrow: int, ncol: int) -> tuple[Column, Column]:
    """(from, to) nodes of an arc of the residue network; ground is the last number.

    The four unused corner slots have nulls.
    """
    axis, r, c = _col(axis), _col(row).cast("long"), _col(col).cast("long")
    ground = F.lit((nrow - 1) * (ncol - 1)).cast("long")
    node = lambda i, j: i * (ncol - 1) + j
    is_row = axis == "row"
    unused = ~is_row & ((r == 0) | (r == nrow - 1)) & ((c == 0) | (c == ncol - 2))
    tail = F.when(is_row, F.when(c == 0, ground).otherwise(node(r, c - 1))).otherwise(F.when(r == 0, ground).otherwise(node(r - 1, c)))
    head = F.when(is_row, F.when(c == ncol - 1, ground).otherwise(node(r, c))).otherwise(F.when(r == nrow - 1, ground).otherwise(node(r, c)))
    return F.when(~unused, tail), F.when(~unused, head)


def packed_distance(dy, dx, i, j) -> Column:
    """Ordering key of a pair of points: distance in 64ths, then the points."""
    dy, dx = _col(dy), _col(dx)
    return F.struct(F.floor(F.sqrt((dx * dx + dy * dy).cast("double")) * 64).alias("q"), _col(i).alias("i"), _col(j).alias("j"))


#: Terms of each ramp, in the order of the coefficients.
RAMPS = {
    "linear": ("row", "col", "1"),
    "quadratic": ("row*row", "col*col", "row*col", "row", "col", "1"),
    "linear_range": ("col", "1"),
    "linear_azimuth": ("row", "1"),
    "quadratic_range": ("col*col", "col", "1"),
    "quadratic_azimuth": ("row*row", "row", "1"),
}


def ramp_terms(kind: str) -> list[Column]:
    """The polynomial terms of a ramp at (row, col)."""
    value = {"row": F.col("row").cast("double"), "col": F.col("col").cast("double"), "1": F.lit(1.0)}

    def term(text: str) -> Column:
        a, *b = text.split("*")
        return value[a] * value[b[0]] if b else value[a]

    return [term(t) for t in RAMPS[kind]]


def effective_looks(range_looks, azimuth_looks, range_spacing, azimuth_spacing, range_resolution, azimuth_resolution):
    """Independent looks: looks times spacing area over resolution area; numbers or columns."""
    return range_looks * azimuth_looks * (range_spacing * azimuth_spacing) / (range_resolution * azimuth_resolution)
