"""Scenes that arrive as a stream: each micro-batch's whole scenes are unwrapped and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame

from phasegrid.options import UnwrapOptions
from phasegrid.plans.unwrap import unwrap


def unwrap_stream(pixels: DataFrame, shape: tuple[int, int], options: UnwrapOptions, path: str, checkpoint: str):
    """Start a query that writes (scene, row, col, unw, conncomp) under `path`; a scene must arrive in one batch."""

    def batch(df: DataFrame, number: int) -> None:
        if df.take(1):
            unwrap(df, shape, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
