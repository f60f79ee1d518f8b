"""Operators for training-data preparation.

Nothing outside this subpackage imports it; ``queries`` registers what it offers.
"""
