"""Operators for preparing text collections for model training."""
