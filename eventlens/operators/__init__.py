"""Analyses of standard events, each from DataFrames to a DataFrame."""
