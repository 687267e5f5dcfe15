"""Operators for training-data pipelines over conversation text. Nothing outside this folder imports it."""
