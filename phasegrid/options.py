"""Options of an unwrapping and their validation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COSTS, INITS = ("smooth", "defo", "topo"), ("mst", "mcf", "laplace")
LAPLACE_OVERLAP = 64


@dataclass(frozen=True)
class CostModel:
    """Fixed values of the statistical cost model; all may be overridden."""

    rho_a: float = 1.3
    rho_b: float = 0.14
    c1: float = 0.4
    c2: float = 0.35
    c3: float = 0.06
    threshold_factor: float = 1.2
    sigsq_corr: float = 0.05
    scale: float = 100.0
    short_cycle: int = 200
    sigsq_min: int = 1
    defo_max: float = 1.2
    component_cost: int = 300
    max_cost: int = 1000
    max_flow: int = 4
    min_cost: int = 1


@dataclass(frozen=True)
class BridgeOptions:
    radius: int = 500
    min_num_pixel: int = 14
    erosion_size: int = 2
    max_boundary_samples: int = 4096
    ramp_type: str | None = None
    ramp_max_num_sample: int = 1_000_000


@dataclass(frozen=True)
class LaplaceOptions:
    """Environment variables PHASEGRID_LAPLACE_* override the defaults."""

    max_iter: int = field(default_factory=lambda: int(os.environ.get("PHASEGRID_LAPLACE_MAX_ITER", 1000)))
    tol: float = field(default_factory=lambda: float(os.environ.get("PHASEGRID_LAPLACE_TOL", 1e-3)))
    reweights: int = field(default_factory=lambda: int(os.environ.get("PHASEGRID_LAPLACE_REWEIGHTS", 16)))
    delta_max: float = field(default_factory=lambda: float(os.environ.get("PHASEGRID_LAPLACE_DELTA_MAX", 0.5)))
    delta_min: float = field(default_factory=lambda: float(os.environ.get("PHASEGRID_LAPLACE_DELTA_MIN", 0.01)))


@dataclass(frozen=True)
class UnwrapOptions:
    nlooks: float
    cost: str = "smooth"
    init: str = "mcf"
    mask_pad_distance: int = 0
    min_conncomp_frac: float = 0.01
    max_ncomps: int = 32
    phase_grad_window: tuple[int, int] = (7, 7)
    ntiles: tuple[int, int] | None = None
    tile_overlap: int | tuple[int, int] | None = None
    target_tile_size: int = 1024
    nproc: int = 1
    single_tile_reoptimize: bool = False
    neighbor_feedback: bool = False
    neighbor_feedback_feather: int = 200
    fix_cycle_spikes: bool = False
    bridge: BridgeOptions | None = None
    reference_pixel: tuple[int, int] | None = (0, 0)
    model: CostModel = CostModel()
    laplace: LaplaceOptions = field(default_factory=LaplaceOptions)
    early_exit: bool = True
    #: Kept for callers; no algorithm reads them.
    tile_cost_thresh: int = 500
    min_region_size: int = 100

    def __post_init__(self) -> None:
        from phasegrid.functions.phase import RAMPS

        if self.cost not in COSTS:
            raise ValueError(f"cost must be one of {COSTS}, got {self.cost!r}")
        if self.init not in INITS:
            raise ValueError(f"init must be one of {INITS}, got {self.init!r}")
        if self.nlooks < 1:
            raise ValueError(f"nlooks must be >= 1, got {self.nlooks}")
        if self.init == "laplace" and self.cost != "smooth":
            raise ValueError("init 'laplace' needs cost 'smooth'")
        if self.bridge and self.bridge.ramp_type is not None and self.bridge.ramp_type not in RAMPS:
            raise ValueError(f"ramp_type must be one of {tuple(RAMPS)} or None, got {self.bridge.ramp_type!r}")
        if self.ntiles is not None and min(self.ntiles) < 1:
            raise ValueError(f"ntiles must be >= 1, got {self.ntiles}")

    def resolved(self, shape: tuple[int, int]) -> UnwrapOptions:
        """With processors, overlaps and tile counts filled in."""
        nproc = self.nproc if self.nproc >= 1 else os.cpu_count() or 1
        overlap = self.tile_overlap
        if overlap is None:
            overlap = LAPLACE_OVERLAP if self.init == "laplace" else 0
        if isinstance(overlap, int):
            overlap = (overlap, overlap)
        ntiles = self.ntiles
        if ntiles is None:
            ntiles = auto_tiles(*shape, self.target_tile_size, *overlap) if self.init == "laplace" or nproc > 1 else (1, 1)
        return replace(self, nproc=nproc, tile_overlap=tuple(overlap), ntiles=tuple(ntiles))


def auto_tiles(nrow: int, ncol: int, target: int, row_overlap: int, col_overlap: int) -> tuple[int, int]:
    """Tile counts that give both axes about one edge length near the target (ties to even)."""
    longest = max(nrow, ncol)
    edge = longest / max(1, round(longest / max(1, target - max(row_overlap, col_overlap))))
    return max(1, round(nrow / edge)), max(1, round(ncol / edge))


_FLOATS = (T.FloatType, T.DoubleType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _field(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"column {name} is missing")
    return df.schema[name].dataType


def check_complex(df: DataFrame, re: str = "re", im: str = "im") -> None:
    """A complex raster is two floating columns."""
    for name in (re, im):
        if not isinstance(_field(df, name), _FLOATS):
            raise TypeError(f"{name} must be a floating part of a complex raster, got {_field(df, name).simpleString()}")


def check_float(df: DataFrame, *names: str) -> None:
    for name in names:
        if not isinstance(_field(df, name), _FLOATS):
            raise TypeError(f"{name} must be floating-point, got {_field(df, name).simpleString()}")


def check_integer(df: DataFrame, *names: str) -> None:
    for name in names:
        if not isinstance(_field(df, name), _WHOLE):
            raise TypeError(f"{name} must be integer, got {_field(df, name).simpleString()}")


def check_mask(df: DataFrame, *names: str) -> None:
    for name in names:
        if not isinstance(_field(df, name), (T.BooleanType, T.ByteType)):
            raise TypeError(f"{name} must be bool or 8-bit integer, got {_field(df, name).simpleString()}")


def check_grid(df: DataFrame, shape: tuple[int, int]) -> None:
    """Each scene has every (row, col) of the shape once."""
    from pyspark.sql import functions as F

    nrow, ncol = shape
    if nrow < 1 or ncol < 1:
        raise ValueError(f"a raster must be 2-D, got shape {shape}")
    check_integer(df, "row", "col")
    bad = (
        df.groupBy("scene")
        .agg(F.count("*").alias("n"), F.count_distinct("row", "col").alias("k"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        .where(f"n <> {nrow * ncol} OR k <> n OR r0 <> 0 OR c0 <> 0 OR r1 <> {nrow - 1} OR c1 <> {ncol - 1}")
        .limit(1)
        .count()
    )
    if bad:
        raise ValueError(f"a scene does not match the expected shape {shape}")
