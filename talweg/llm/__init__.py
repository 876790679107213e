"""Operators for training data: percentiles, splits, leaked passages, mixtures and keyword pages. Nothing outside imports this package."""
