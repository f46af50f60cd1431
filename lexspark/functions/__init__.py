"""Scalar functions and word lists."""
