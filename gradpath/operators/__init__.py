"""The analytic operators; each maps DataFrames to DataFrames."""
