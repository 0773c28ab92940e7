"""Logical plan nodes and their rewriting."""
