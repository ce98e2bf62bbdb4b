"""Scalar helpers, tokenizers and table functions."""
