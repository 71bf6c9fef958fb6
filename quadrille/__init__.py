"""Labelled-axis array analytics on Spark DataFrames."""
