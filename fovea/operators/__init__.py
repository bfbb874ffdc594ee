"""Operators on movies: folds, products, sweeps, segmentation, views."""
