"""Partitioned data processing on Spark DataFrames: chunk and tile plans, stencil kernels, catalog operators, streams."""
