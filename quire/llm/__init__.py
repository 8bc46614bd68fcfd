"""Operators that clean, encode, mix and split text for training corpora.

Nothing outside this package imports it.
"""
