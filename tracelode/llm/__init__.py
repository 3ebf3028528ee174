"""Operators that prepare text and token data for training."""
