"""basalt: a table engine and training-data toolkit built on PySpark DataFrames."""

__version__ = "0.1.0"
