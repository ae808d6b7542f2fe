"""Security-event analytics as Spark jobs.

Layers, from the bottom up:

* ``functions``  column expressions and the fixed value tables behind them
* ``sources``    readers, logical table names, shapers for the given tables
* ``operators``  DataFrame -> DataFrame building blocks and reports
* ``sinks``      writers
* ``streaming``  the same operators run by Structured Streaming
* ``plans``      named queries with their SQL twins
"""
