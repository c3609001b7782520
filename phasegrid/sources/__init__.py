"""Rasters in and out of DataFrames."""

from phasegrid.sources.raster import (
    dump_arcs,
    embedding_raster,
    from_arrays,
    from_blocks,
    read_flat,
    register_flat,
    to_arrays,
    to_blocks,
    write_raster,
)

__all__ = ["dump_arcs", "embedding_raster", "from_arrays", "from_blocks", "read_flat", "register_flat", "to_arrays", "to_blocks", "write_raster"]
