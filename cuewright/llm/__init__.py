"""Operators for training text: sentences, repetition, packing, leaks, truncation and the like.

Nothing else in the library imports this subpackage.
"""
