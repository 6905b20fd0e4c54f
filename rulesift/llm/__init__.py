"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; ``QUERIES`` and ``ORACLE`` there are what the driver's entry
file picks up.
"""
