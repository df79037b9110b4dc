"""Array datasets on Spark: named dimensions, typed variables, attributes and fill values as DataFrames."""

__version__ = "0.1.0"
