"""Operators for preparing training data.

Nothing else in paperloom imports this subpackage, so it can be removed whole.
"""
