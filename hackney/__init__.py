"""Hackney: trip files in, clean tables and feature products out, on Spark.

The layers are plain functions over DataFrames:

* ``hackney.functions``  column expressions (zones, distance, calendar, levels)
* ``hackney.operators``  DataFrame transforms (rolling statistics, merge,
  numbering, incremental sets, validation)
* ``hackney.sources``    CSV files, fingerprints, stored tables, JDBC
* ``hackney.plans``      raw, silver, gold, products, export, whole pipeline
* ``hackney.streaming``  file arrivals through Structured Streaming
"""
