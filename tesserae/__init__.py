"""Whole-slide image analytics on Spark DataFrames."""
