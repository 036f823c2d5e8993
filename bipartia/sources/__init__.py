"""Readers, writers and tables cut off from their lineage."""
