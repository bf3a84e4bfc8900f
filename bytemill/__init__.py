"""Byte-column transforms and training-data operators expressed as Spark DataFrames."""
