"""Whole pipelines over the operators."""
