"""Volumetric tile analytics on Spark DataFrames."""
