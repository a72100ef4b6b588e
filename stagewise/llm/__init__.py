"""Operators for large training-data pipelines. Nothing outside this folder depends on it."""
