"""Structured Streaming variants of operators."""
