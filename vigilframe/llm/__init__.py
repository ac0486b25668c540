"""Operators for preparing training text at corpus scale, and their named queries.

Nothing else in the library imports this subpackage.
"""
