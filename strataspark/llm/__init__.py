"""Operators for training-data pipelines, one module each, with their queries beside them."""
