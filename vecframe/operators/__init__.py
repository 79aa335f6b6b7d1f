"""Operators: filters, search, inverted lists and quantization."""
