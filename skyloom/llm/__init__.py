"""Operators for training data: percentiles, token encoding, packing, prose statistics.

Nothing outside this folder imports it.
"""
