"""Operators for building training data at corpus scale.

Nothing else in the library imports this subpackage; it may import general
helpers from the rest (``session``).
"""
