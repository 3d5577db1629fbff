"""Operators for large training-corpus pipelines; ``queries`` registers them."""
