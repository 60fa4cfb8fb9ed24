"""verdin: a Spark-native engine for tabular profiling, time-series features,
forecast-driven decisions and model lifecycle tables.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from Spark SQL
expressions, joins, windows and Spark ML; see README.md for the map.
"""

__version__ = "0.1.0"
