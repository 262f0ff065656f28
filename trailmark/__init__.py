"""Trajectory analytics on Spark: DataFrame-in, DataFrame-out operators.

Nothing here owns a session. Functions under ``functions`` build Column
expressions, ``operators`` build DataFrames, ``sources`` read and write tables,
``streaming`` holds the Structured Streaming variants and ``plans`` binds the
operators to the test tables.
"""

__version__ = "0.1.0"
