"""Iterative solvers of one tile, in numpy."""
