"""Rasters: long form (scene, row, col, ...), block form, arrays, flat binary files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIXELS = "scene string, row int, col int"


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a raster: row = vector, col = component."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.lit("embeddings").alias("scene"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"), "label").withColumn("v", F.col("v").cast("double"))


def raster_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    r = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    return int(r[0]), int(r[1])


def from_arrays(spark: SparkSession, scene: str = "scene", **planes) -> DataFrame:
    """Long form of 2-D arrays (or anything with __array__); a complex one gives re and im."""
    arrays: dict[str, np.ndarray] = {}
    for name, plane in planes.items():
        a = np.asarray(plane)
        if a.ndim != 2:
            raise ValueError(f"{name} must be 2-D, got ndim={a.ndim}")
        if np.iscomplexobj(a):
            arrays |= {"re": a.real.astype(np.float32), "im": a.imag.astype(np.float32)}
        else:
            arrays[name] = a
    shapes = {a.shape for a in arrays.values()}
    if len(shapes) != 1:
        raise ValueError(f"shapes do not match: {sorted(shapes)}")
    nrow, ncol = shapes.pop()
    row, col = np.indices((nrow, ncol), dtype=np.int32)
    table = {"scene": pa.array([scene] * (nrow * ncol)), "row": row.ravel(), "col": col.ravel()}
    return spark.createDataFrame(pa.table(table | {k: np.ascontiguousarray(a).ravel() for k, a in arrays.items()}))


def to_arrays(df: DataFrame, shape: tuple[int, int], *names: str, out: dict | None = None) -> dict:
    """One small scene as arrays; `out` arrays are filled in place (cast) and returned."""
    t = df.select("row", "col", *names).toArrow()
    at = t.column("row").to_numpy(), t.column("col").to_numpy()
    found = {}
    for name in names:
        values = t.column(name).to_numpy()
        target = (out or {}).get(name)
        plane = np.zeros(shape, values.dtype)
        plane[at] = values
        if target is not None:
            target[...] = plane.astype(target.dtype)
        found[name] = plane if target is None else target
    return found


def write_raster(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by scene, so that a reader of one scene prunes the others."""
    df.repartition("scene").sortWithinPartitions("row", "col").write.mode(mode).partitionBy("scene").parquet(path)


def dump_arcs(arcs: DataFrame, path: str) -> None:
    """Debug copy of flows and costs."""
    arcs.write.mode("overwrite").partitionBy("axis").parquet(path)


def to_blocks(df: DataFrame, tile: tuple[int, int], *names: str) -> DataFrame:
    """Block form: one row for each tile with its planes as row-major arrays of floats."""
    tr, tc = (F.floor(F.col(c) / n).cast("int") for c, n in zip(("row", "col"), tile, strict=True))
    entries = F.array_sort(F.collect_list(F.struct("row", "col", *[F.col(n).cast("float").alias(n) for n in names])))
    blocks = df.groupBy("scene", tr.alias("tr"), tc.alias("tc")).agg(entries.alias("e"))
    ncol = F.array_max("e.col") - F.array_min("e.col") + 1
    nrow = F.array_max("e.row") - F.array_min("e.row") + 1
    return blocks.select("scene", "tr", "tc", F.array_min("e.row").alias("first_row"), F.array_min("e.col").alias("first_col"), nrow.alias("nrow"), ncol.alias("ncol"), *[F.col(f"e.{n}").alias(n) for n in names])


def from_blocks(blocks: DataFrame, *names: str) -> DataFrame:
    """Back to long form."""
    at = F.posexplode(F.arrays_zip(*names)).alias("k", "e")
    df = blocks.select("scene", "first_row", "first_col", "ncol", at)
    row = (F.col("first_row") + F.floor(F.col("k") / F.col("ncol"))).cast("int")
    return df.select("scene", row.alias("row"), (F.col("first_col") + F.col("k") % F.col("ncol")).cast("int").alias("col"), *[F.col(f"e.{n}").alias(n) for n in names])


KINDS = {"complex64": "<c8", "float32": "<f4", "uint8": "u1"}


class _Lines(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class FlatReader(DataSourceReader):
    """Row-major flat binary: each partition seeks to its own lines."""

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "float32")
        self.nrow, self.ncol = int(options["nrow"]), int(options["ncol"])
        self.scene, self.step = options.get("scene", "scene"), int(options.get("lines", 256))

    def partitions(self):
        return [_Lines(a, min(a + self.step, self.nrow)) for a in range(0, self.nrow, self.step)]

    def read(self, part: _Lines):
        kind = np.dtype(KINDS[self.kind])
        lines = part.last - part.first
        with open(self.path.removeprefix("file://"), "rb") as f:
            f.seek(part.first * self.ncol * kind.itemsize)
            a = np.frombuffer(f.read(lines * self.ncol * kind.itemsize), kind)
        if len(a) != lines * self.ncol:
            raise ValueError(f"{self.path} is shorter than {self.nrow} x {self.ncol} {self.kind}")
        row = np.repeat(np.arange(part.first, part.last, dtype=np.int32), self.ncol)
        col = np.tile(np.arange(self.ncol, dtype=np.int32), lines)
        planes = [("re", a.real.astype(np.float32)), ("im", a.imag.astype(np.float32))] if a.dtype.kind == "c" else [("value", a)]
        t = pa.table({"scene": pa.array([self.scene] * len(a)), "row": row, "col": col} | dict(planes))
        yield from t.to_batches()


class FlatRaster(DataSource):
    """spark.read.format("flat_raster").option("path", ...).option("kind", "complex64" | "float32" | "uint8")"""

    @classmethod
    def name(cls) -> str:
        return "flat_raster"

    def schema(self) -> str:
        kind = self.options.get("kind", "float32")
        return f"{PIXELS}, " + {"complex64": "re float, im float", "float32": "value float", "uint8": "value short"}[kind]

    def reader(self, schema):
        return FlatReader(self.options)


def register_flat(spark: SparkSession) -> None:
    spark.dataSource.register(FlatRaster)


def read_flat(spark: SparkSession, path: str, shape: tuple[int, int], kind: str = "complex64", scene: str = "scene") -> DataFrame:
    """A row-major flat file in any store that Spark reads: fixed-length records, one for each line."""
    kind_ = np.dtype(KINDS[kind])
    nrow, ncol = shape
    complex_ = kind_.kind == "c"
    names = ["re", "im"] if complex_ else ["value"]
    binary = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                a = np.frombuffer(content.as_buffer(), kind_)
                if len(a) != nrow * ncol:
                    raise ValueError(f"{path} does not hold {nrow} x {ncol} {kind}")
                for r in range(0, nrow, 256):
                    part = a[r * ncol : (r + 256) * ncol]
                    n = len(part) // ncol
                    planes = [part.real, part.imag] if complex_ else [part]
                    yield pa.RecordBatch.from_arrays([pa.array([scene] * len(part)), pa.array(np.repeat(np.arange(r, r + n, dtype=np.int32), ncol)), pa.array(np.tile(np.arange(ncol, dtype=np.int32), n)), *[pa.array(p.astype(np.float32)) for p in planes]], ["scene", "row", "col", *names])

    return binary.mapInArrow(run, f"{PIXELS}, " + ", ".join(f"{n} float" for n in names))
