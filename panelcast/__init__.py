"""panelcast: panel cohorts, scenario forecasts and forest inference on Spark.

Everything is expressed with DataFrames, window functions and MLlib.  Column
names and thresholds are arguments; the defaults in ``panelcast.spec`` describe
the analogue panel built from the TPC-H-like test tables.
"""

__version__ = "0.1.0"
