"""Whole analyses, and the queries that expose the operators."""
