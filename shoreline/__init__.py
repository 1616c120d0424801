"""Shoreline: cryptographic-inventory and post-quantum readiness analytics on Spark.

Sub-packages
------------
``rules``      fixed rule tables, as plain data
``functions``  Column expressions (no joins, no shuffles)
``sources``    readers: files or raw rows to typed DataFrames
``operators``  DataFrame to DataFrame transforms over findings
``plans``      the operators put together: scan, sensor log, verdict
``streaming``  the sensor-log plan as Structured Streaming
``sinks``      writers for findings, components, history and cache
"""

__version__ = "0.1.0"
