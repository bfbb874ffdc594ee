"""Operators of a training-data pipeline, built on DataFrames.

Nothing else in the package imports this subpackage.
"""
