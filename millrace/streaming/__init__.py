"""Structured Streaming forms of windowed and keyed operators."""
