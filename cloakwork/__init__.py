"""Reversible de-identification of text on Spark DataFrames."""
