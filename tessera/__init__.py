"""Tessera: spatial hierarchies, their validation and training-data operators on Spark DataFrames."""
