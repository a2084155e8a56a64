"""Household-panel analytics on Spark DataFrames."""
