"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``registry`` holds the
queries that apply each operator to its whole table.
"""
