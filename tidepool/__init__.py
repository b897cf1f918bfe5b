"""tidepool: a Spark-native data-sync engine.

Operators are functions from DataFrames to DataFrames built on Spark SQL,
Catalyst built-ins and Structured Streaming.
"""

__version__ = "0.1.0"
