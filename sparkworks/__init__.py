"""Tabular analytics and applied machine learning on PySpark DataFrames."""
