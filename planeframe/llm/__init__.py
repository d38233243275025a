"""Operators for building training corpora: formatting, deduplication, filtering, mixing and packing.

Nothing outside this subpackage imports it.
"""
