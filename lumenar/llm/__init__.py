"""Operators that prepare text for training: cut texts, clusters, split leakage, grouped splits, near duplicates, broken pairs, packing, mixing and language.

Nothing outside this package imports it.
"""
