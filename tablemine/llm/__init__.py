"""Operators for preparing training data out of large document tables.

Nothing else in the library imports this subpackage.
"""
