"""Operators for large-scale training-data pipelines; optional, nothing else imports it."""
