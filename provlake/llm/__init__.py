"""Operators of a training-data pipeline; see README for each method and its limits."""
