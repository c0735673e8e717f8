"""Operators of a training-data pipeline, with one registered query each.

Nothing else in the library imports this package. ``queries.load()`` registers.
"""
