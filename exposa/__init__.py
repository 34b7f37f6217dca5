"""exposa: insurance-pricing analytics on Spark DataFrames.

Sub-packages
------------
sources    readers, writers and the stand-in tables built from the driver data
functions  column expressions (scalar rules of the cleaning steps)
operators  DataFrame -> DataFrame operators (gates, joins, windows, grouping,
           geography, exploratory statistics, rating tables, sampling, prep)
models     GLM / tree fits on Spark ML plus the few families Spark lacks
plans      staged plans (clean -> dimension -> encodings -> policy table) and
           the query catalogue with its DuckDB oracle
"""

from exposa.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
