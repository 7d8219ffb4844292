"""Revenue analytics and forecasting on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame. Time-series
operators take ``keys``, the columns that identify one series; an empty list
means one global series.
"""

__version__ = "0.1.0"
