"""Operators for training-data pipelines; nothing else here imports them."""
