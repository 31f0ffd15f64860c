"""Gradient boosting and training-data operators on Spark DataFrames."""
