"""Elasticity and classification models, their splits, weights and metrics."""
