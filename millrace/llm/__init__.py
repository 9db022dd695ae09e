"""Operators for training-data pipelines, one module each; nothing outside this subpackage imports it."""
