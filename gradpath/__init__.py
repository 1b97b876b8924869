"""Placement scoring, what-if and skill-graph analytics on Spark DataFrames."""

__version__ = "0.1.0"
