"""Durable tables and interchange formats."""
