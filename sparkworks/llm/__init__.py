"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; deleting it leaves the
rest of the library whole.
"""
