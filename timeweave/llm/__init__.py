"""Operators of a large-scale training-data pipeline.

Nothing else in ``timeweave`` imports this subpackage. Each operator module has
a general function over DataFrames; ``queries`` derives the contract columns.
"""
