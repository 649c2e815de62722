"""Operators for training-data pipelines: one module per operator, each from DataFrame to DataFrame."""
