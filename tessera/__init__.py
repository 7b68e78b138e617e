"""Equity analytics on Spark DataFrames."""
