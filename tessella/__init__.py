"""Tessella: weighted-event analytics on Spark DataFrames."""
