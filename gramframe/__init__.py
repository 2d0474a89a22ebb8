"""gramframe: kernel-method classification studies as Spark DataFrame jobs.

Sub-packages
------------
sources    fixtures over the given tables, the CSV contract scan, sinks, job parameters
functions  column expressions (hash order, angle encoding, per-pair kernel terms)
operators  DataFrame -> DataFrame operators (profile, sampling, preprocessing,
           kernels, kernel statistics, metrics, models, reports)
plans      the registered queries and their DuckDB oracle statements
streaming  fitted, stateless transforms applied to a streaming input
"""

__all__ = ["session"]
