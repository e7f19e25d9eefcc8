"""scatterspark: scattered-data and kernel analytics on Spark DataFrames."""

__version__ = "0.1.0"
