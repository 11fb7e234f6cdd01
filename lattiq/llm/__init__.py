"""Operators for preparing large text corpora: dedup, scoring, mixing, packing and storage.

Nothing outside this subpackage imports it.
"""
