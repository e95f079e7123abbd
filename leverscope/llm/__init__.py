"""Operators of a training-data pipeline: language, duplicates, quality, privacy, packing, scoring.

Nothing else in the library imports this subpackage.
"""
