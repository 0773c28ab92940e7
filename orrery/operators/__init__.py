"""Relational, vector and graph operators as DataFrame plans."""
