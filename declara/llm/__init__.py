"""Operators for preparing large text corpora: filtering, near-duplicates, mixing, packing and scans.

Nothing else in the library imports this subpackage.
"""
