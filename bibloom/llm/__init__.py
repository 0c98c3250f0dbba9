"""Operators of a training-data pipeline.

Nothing outside this package imports it, so it can be removed as a whole.
"""
