"""Declarative raster operators: DataFrame in, DataFrame out."""
