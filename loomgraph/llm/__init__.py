"""Operators for large text corpora: de-duplication, tokenising, scoring and packing.

Nothing else in the library imports this subpackage.
"""
