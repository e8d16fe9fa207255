"""Operators: DataFrames and parameters in, one DataFrame out, no action started."""
