"""Gridded measurements as DataFrames: statistics, stencils and restoration on Spark.

The unit of data is a *cell table*: one row per grid cell with the columns
``img, t, c, z, y, x, v``.  Every operator takes and returns DataFrames.
"""
