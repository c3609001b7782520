"""Tiles: geometry, split, offsets between neighbours, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.functions.phase import TWO_PI


def spans(n: int, tiles: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) of each tile along one axis."""
    first = [t * (n - overlap) // tiles for t in range(tiles)]
    return [(a, n if t == tiles - 1 else first[t + 1] + overlap) for t, a in enumerate(first)]


def geometry(spark: SparkSession, shape: tuple[int, int], ntiles: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """The tile table, generated in the plan (its size is the number of tiles)."""

    def axis(name: str, n: int, t: int, ov: int) -> DataFrame:
        k = F.col("id")
        first = F.call_function("div", k * (n - ov), F.lit(t))
        last = F.when(k == t - 1, n).otherwise(F.call_function("div", (k + 1) * (n - ov), F.lit(t)) + ov)
        return spark.range(t).select(k.cast("int").alias(f"t{name[0]}"), first.cast("int").alias(f"first_{name}"), (last - first).cast("int").alias(f"n{name}"))

    rows, cols = axis("row", shape[0], ntiles[0], overlap[0]), axis("col", shape[1], ntiles[1], overlap[1])
    return rows.crossJoin(cols).select("tr", "tc", "first_row", "first_col", "nrow", "ncol")


def _div(a, b: int):
    return F.call_function("div", a, F.lit(b))


def split(df: DataFrame, shape: tuple[int, int], ntiles: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """Each pixel once for each tile that holds it: the first and the last such tile are arithmetic, not looked up."""

    def ids(name: str, k: int):
        x, n, tiles = F.col(name).cast("long"), max(1, shape[k] - overlap[k]), ntiles[k]
        # Tile t starts at t * n div tiles, and ends where the next starts, overlap lines later.
        last = F.least(_div((x + 1) * tiles - 1, n), F.lit(tiles - 1))
        first = F.least(_div(F.greatest(x - overlap[k] + 1, F.lit(0)) * tiles + n - 1, n) - 1, F.lit(tiles - 1))
        return F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.greatest(last, F.lit(0)).cast("int")))

    return df.withColumn("tr", ids("row", 0)).withColumn("tc", ids("col", 1))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The lower weighted median: the smallest value with at least half the weight up to it (0 if none)."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_acc": F.sum(weight).over(upto), "_all": F.sum(weight).over(group)})
    return df.groupBy(*keys).agg(F.min(F.when(F.col("_acc") >= F.col("_all") / 2, F.col(value))).alias("median"))


def neighbour_offsets(tiles: DataFrame, shape: tuple[int, int], ntiles: tuple[int, int], overlap: tuple[int, int], axis: str, fractional: bool, floor: float = 0.05) -> DataFrame:
    """(scene, tr, tc, cycles) of each tile against the one before it along the axis.

    Only overlap pixels are shuffled: both sides are filtered to the strip that
    the neighbours share before the join.
    """
    k, me, other, line = (1, "tc", "tr", "col") if axis == "horizontal" else (0, "tr", "tc", "row")
    if overlap[k] <= 0:
        return tiles.select("scene", "tr", "tc").distinct().where(f"{me} > 0").withColumn("cycles", F.lit(0.0))
    x, n = F.col(line), max(1, shape[k] - overlap[k])
    good = F.col("corr") >= floor
    if "conf" in tiles.columns:
        good = good & F.col("conf")
    start = lambda t: _div(t.cast("long") * n, ntiles[k])
    strip = lambda t: (x >= start(t)) & (x < start(t) + overlap[k])
    head = (F.col(me) > 0) & strip(F.col(me))
    tail = (F.col(me) < ntiles[k] - 1) & strip(F.col(me) + 1)
    names = ["scene", other, "row", "col"]
    left = tiles.where(good & tail).select(*names, (F.col(me) + 1).alias(me), F.col("unw").alias("u0"), F.col("corr").alias("c0"))
    right = tiles.where(good & head).select(*names, me, F.col("unw").alias("u1"), F.col("corr").alias("c1"))
    pairs = left.join(right, [*names, me]).select("scene", "tr", "tc", (F.col("u0") - F.col("u1")).alias("diff"), F.least("c0", "c1").alias("weight"))
    cycles = F.coalesce(F.col("median"), F.lit(0.0)) / TWO_PI
    return weighted_median(pairs, ["scene", "tr", "tc"], "diff", "weight").select("scene", "tr", "tc", (cycles if fractional else F.round(cycles)).alias("cycles"))


def tile_offsets(horizontal: DataFrame, vertical: DataFrame, tiles: DataFrame) -> DataFrame:
    """(scene, tr, tc, cycles) against tile (0, 0): along the first row, then down each column."""
    every = tiles.select("scene", "tr", "tc").distinct()
    h = every.join(horizontal.where("tr = 0").withColumnRenamed("cycles", "h"), ["scene", "tr", "tc"], "left")
    h = h.join(vertical.withColumnRenamed("cycles", "v"), ["scene", "tr", "tc"], "left")
    h = h.withColumns({"h": F.coalesce("h", F.lit(0.0)), "v": F.coalesce("v", F.lit(0.0))})
    across = Window.partitionBy("scene", "tr").orderBy("tc").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("scene", "tc").orderBy("tr").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("h", F.when(F.col("tr") == 0, F.sum("h").over(across)).otherwise(0.0))
    return h.select("scene", "tr", "tc", F.sum(F.col("h") + F.col("v")).over(down).alias("cycles"))


def label_offsets(tiles: DataFrame) -> DataFrame:
    """(scene, tr, tc, offset): labels used by the tiles before it in raster order."""
    most = tiles.groupBy("scene", "tr", "tc").agg(F.max("conncomp").alias("most"))
    before = Window.partitionBy("scene").orderBy("tr", "tc").rowsBetween(Window.unboundedPreceding, -1)
    return most.select("scene", "tr", "tc", F.coalesce(F.sum("most").over(before), F.lit(0)).alias("offset"))


def owned(df: DataFrame, shape: tuple[int, int], ntiles: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """Of the copies of a pixel, the one that the merge keeps: the last tile that starts half an overlap before."""

    def owner(name: str, k: int):
        # The last t with t * n div tiles + overlap div 2 <= x.
        n = max(1, shape[k] - overlap[k])
        t = _div((F.col(name).cast("long") - overlap[k] // 2 + 1) * ntiles[k] - 1, n)
        return F.least(F.greatest(t, F.lit(0)), F.lit(ntiles[k] - 1))

    return df.where((F.col("tr") == owner("row", 0)) & (F.col("tc") == owner("col", 1)))


def merge(tiles: DataFrame, shape: tuple[int, int], ntiles: tuple[int, int], overlap: tuple[int, int], offsets: DataFrame | None = None) -> DataFrame:
    """One raster: tile offsets in whole or fractional cycles added, labels made distinct."""
    keep = owned(tiles, shape, ntiles, overlap)
    keys = ["scene", "tr", "tc"]
    keep = keep.join(label_offsets(tiles), keys)
    if offsets is not None:
        keep = keep.join(offsets, keys).withColumn("unw", F.col("unw") + TWO_PI * F.col("cycles")).drop("cycles")
    label = F.when(F.col("conncomp") == 0, 0).otherwise(F.col("conncomp") + F.col("offset"))
    return keep.withColumn("conncomp", label).drop("offset", "tr", "tc")
