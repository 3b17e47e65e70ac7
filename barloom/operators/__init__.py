"""Operators on long tables keyed by ticker: DataFrames in, DataFrames out, no actions inside unless said."""
